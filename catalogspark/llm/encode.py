"""Token ids of whole texts by the public tokenizers, through a bounded cache of
word encodings.

Both BPE files cut a text at white space before any merge, so the ids of a text
are the ids of its blank-separated pieces in order. A worker keeps the ids of
the pieces it has met and asks the library only for new ones.
A text in which that cut isn't provably neutral goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Bytes of what a worker remembers, in two halves: when one is full, the older one
#: goes, and with it the pieces that haven't been met since.
CACHE_BYTES = 96 << 20
#: What a piece takes beside its own bytes and those of its ids, about.
PIECE_OVERHEAD = 150
#: A longer piece isn't remembered.
PIECE_BYTES = 64

_ODD_BLANK = re.compile(r"^\s|\s$|\s\s|[^\S \n]")
#: Other white space of ASCII, and what the bytes of wider white space begin with.
_CONTROLS = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def _odd_blanks(data: bytes) -> bool:
    """Whether _ODD_BLANK is found; only texts that may hold wide white space
    are searched by it."""
    if data[0] in b" \n" or data[-1] in b" \n" or any(p in data for p in (b"  ", b"\n\n", b" \n", b"\n ")):
        return True
    if len(data.translate(None, _CONTROLS)) < len(data):
        return True
    return not data.isascii() and any(w in data for w in _WIDE) and bool(_ODD_BLANK.search(data.decode()))


_LATIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: ASCII marks that are a pre-token of their own behind a letter. The apostrophe
#: isn't one: it may begin an ending such as 's.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids of pieces, within CACHE_BYTES; `ids` finds those of others."""

    def __init__(self, ids: Callable[[bytes], bytes]):
        super().__init__()
        self.ids, self.older, self.held = ids, {}, 0

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            return self.ids(piece)
        self.keep(piece, ids)
        return ids

    def keep(self, piece: bytes, ids: bytes) -> None:
        self[piece] = ids
        self.held += len(piece) + len(ids) + PIECE_OVERHEAD
        if self.held >= CACHE_BYTES // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0


class Encoder:
    """`encode(texts)` gives for each text its ids as `<u4` bytes, exactly as the
    library gives them with add_special_tokens=False and its other defaults.
    None counts as an empty text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.known = _Known(self._ids)
        # the byte alphabet of byte-level BPE: printable Latin-1 stands for itself
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(other)}
        self.merges = self.library.model.tokenize
        self.special = [token["content"] for token in spec["added_tokens"]]
        pre, normalizer = spec["pre_tokenizer"], spec["normalizer"] or {}
        kinds = [step["type"] for step in normalizer.get("normalizers", [])]
        if pre["type"] == "Sequence" and kinds == ["NFC", "Replace", "Lowercase"]:
            self.cut, self.blank = self._at_white_space, ""
        elif pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not normalizer:
            self.cut, self.blank = self._before_blanks, self.alphabet[32]
        else:
            self.cut = lambda text: None

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _at_white_space(self, text: str) -> list[bytes] | None:
        """White space is dropped and case folded; folding ASCII here must not
        make a special string. The library composes marks before it folds case, so
        in texts with combining marks (lead bytes CC and CD) only pieces without
        any are folded here."""
        if "<|" in text:
            return None
        data = text.encode()
        if b"\xcc" in data or b"\xcd" in data:
            return [p.lower() if p.isascii() else p for p in data.split()]
        return data.lower().split()

    def _before_blanks(self, text: str) -> list[bytes] | None:
        """A blank belongs to the word behind it, and a single line feed is a
        pre-token. A piece with a leading blank here stands for the word without
        it, one with a leading line feed for that and the word, others for a
        blank and the word."""
        data = text.encode()
        if not data or _odd_blanks(data) or any(s in text for s in self.special):
            return None
        pieces = data.replace(b"\n", b" \n").split(b" ")
        pieces[0] = b" " + pieces[0]
        return pieces

    def _text(self, piece: bytes) -> str:
        if self.cut == self._before_blanks:
            piece = piece[1:] if piece[0] == 32 else piece if piece[0] == 10 else b" " + piece
        return piece.decode()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        look = self.known.__getitem__
        for text in texts:
            pieces = self.cut(text) if text else []
            yield self.whole(text) if pieces is None else b"".join(map(look, pieces))

    def _ids(self, piece: bytes) -> bytes:
        """Ids of a piece that isn't known, which is remembered unless it is long or
        made of others: a line feed before a word and marks behind an ASCII letter
        are encoded on their own."""
        known = self.known
        blanks = self.cut == self._before_blanks
        if blanks and piece[0] == 10 and len(piece) > 1:
            return known[b"\n"] + known[b" " + piece[1:]]
        if piece[-1] in _MARKS:
            word = piece.rstrip(_MARKS)
            if word[-1:].isalpha():
                marks = piece[len(word) :]
                return known[word] + known[b" " + marks if blanks else marks]
        ids = self._merged(piece)
        if ids is None:
            got = self.library.encode([self._text(piece)], is_pretokenized=True, add_special_tokens=False)
            ids = _pack(got.ids)
        if len(piece) <= PIECE_BYTES:
            known.keep(piece, ids)
        return ids

    def _merged(self, piece: bytes) -> bytes | None:
        """Ids of a word of Latin letters, one pre-token: the library's merges
        on it in the byte alphabet, its case folded if the file folds case.
        Else None."""
        if piece.isalpha():  # ASCII letters alone
            text = self.blank + piece.decode()
        else:
            text = self._text(piece)
            if not _LATIN.fullmatch(text):
                return None
            if self.library.normalizer is not None:
                text = text.lower()
                if not _LATIN.fullmatch(text):
                    return None
            text = text.encode().decode("latin-1").translate(self.alphabet)
        return _pack([token.id for token in self.merges(text)])


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file; workers are reused by later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
