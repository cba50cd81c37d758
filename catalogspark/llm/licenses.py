"""Licence notices: exact phrases, and short notices within a bounded number of
edits.

A notice matched with at most k edits holds one of any k + 1 pieces of it
unchanged. Those pieces are searched exactly in a text's words joined by single
blanks; around each place found, the regex library looks for the whole notice
within k edits and gives its span. Words that tell one licence from another are
matched exactly, and edits fall on the rest.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.frames import slices, table, texts

#: Phrases that count where their words stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices searched with edits, in words joined by single blanks, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the apache license": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution": "cc",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "reserved",
}
#: Words of notices that must stand unchanged: with edits they name another licence
#: (`bsd` and `gpl` for `mit`, `by sa` for `by nc`).
EXACT = {"released under the mit license": "mit", "licensed under cc by nc": "nc"}
#: One edit is allowed for so many characters of a notice.
CHARACTERS_AN_EDIT = 9

_WORD = bytes(
    32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def normal(text: str | None) -> bytes:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased, joined by
    single blanks."""
    return b" ".join((text or "").encode().translate(_WORD).split())


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """edits + 1 pieces of about equal length, with their places."""
    ends = np.linspace(0, len(notice), edits + 2).astype(int)
    return [(int(a), notice[a:b]) for a, b in zip(ends[:-1], ends[1:])]


class Notice:
    def __init__(self, text: str, label: str, exact: str | None = None):
        import regex

        self.text, self.label = text.encode(), label
        self.edits = len(self.text) // CHARACTERS_AN_EDIT
        self.seeds = pieces(self.text, self.edits)
        # a match begins and ends with whole words of the text
        found = [b"(?:%s){e<=%d}" % (regex.escape(self.text, special_only=True), self.edits)]
        if exact:
            word = exact.encode()
            at = (b" " + self.text + b" ").index(b" " + word + b" ")
            ways = [(e, self.edits - e) for e in range(self.edits + 1)]
            ends = self.text[:at], self.text[at + len(word):]
            if not all(ends):
                ways = [(self.edits, self.edits)]
            before, after = (regex.escape(end, special_only=True) for end in ends)
            word = rb"(?<![^ ])" + regex.escape(word, special_only=True) + rb"(?![^ ])"
            found = [
                (b"(?:%s){e<=%d}" % (before, e) if before else b"") + word + (b"(?:%s){e<=%d}" % (after, f) if after else b"")
                for e, f in ways
            ]
        self.pattern = regex.compile(rb"(?be)(?<![^ ])(?:" + b"|".join(found) + rb")(?![^ ])")

    def windows(self, text: bytes) -> Iterator[tuple[int, int]]:
        """Stretches of the text that hold every match, one for each place of a
        seed and none longer than a notice and its edits."""
        reach, found = self.edits + 1, set()
        for at, seed in self.seeds:
            place = text.find(seed)
            while place >= 0:
                found.add((max(0, place - at - reach), min(len(text), place - at + len(self.text) + reach)))
                place = text.find(seed, place + 1)
        yield from sorted(found)

    def _within(self, text: bytes, low: int, high: int) -> Iterator[tuple[int, int, float]]:
        """The best match of a stretch, and those on both sides of it."""
        if high - low < len(self.text) - self.edits:
            return
        match = self.pattern.search(text, low, high)
        if match and match.end() > match.start():
            yield match.start(), match.end(), 1 - sum(match.fuzzy_counts) / len(self.text)
            yield from self._within(text, low, match.start())
            yield from self._within(text, match.end(), high)

    def matches(self, text: bytes) -> list[tuple[int, int, float]]:
        """(start, end, similarity) of matches in the text, by place. Of matches that
        overlap the most similar one counts, of equal ones the first."""
        found = {span for low, high in self.windows(text) for span in self._within(text, low, high)}
        starts: list[int] = []
        kept: list[tuple[int, int, float]] = []
        for span in sorted(found, key=lambda s: (-s[2], s[0], s[1])):
            at = bisect(starts, span[0])
            if (not at or kept[at - 1][1] <= span[0]) and (at == len(kept) or span[1] <= kept[at][0]):
                starts.insert(at, span[0])
                kept.insert(at, span)
        return kept


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Places of the phrase's words in the text, by word from 0."""
    framed, sought, out = b" " + text + b" ", b" " + phrase + b" ", []
    place, counted, words = framed.find(sought), 0, 0
    while place >= 0:
        words += framed.count(b" ", counted, place)
        counted = place
        out.append(words)
        place = framed.find(sought, place + 1)
    return out


def _scan(phrases: dict[str, str], notices: dict[str, str]):
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [(p.encode(), label) for p, label in phrases.items()]
        fuzzy = [Notice(text, label, EXACT.get(text)) for text, label in notices.items()]
        for batch in slices(batches, 1):
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base", "labels", "score", "spans")}
            for value in batch.column(1).to_pylist():
                text = normal(value)
                found = {(p, label): places for p, label in exact if (places := _places(text, p))}
                starts = [at for places in found.values() for at in places]
                base = {label for _, label in found}
                spans = [
                    {"label": n.label, "start": a, "end": b, "similarity": s}
                    for n in fuzzy for a, b, s in n.matches(text)
                ]
                out["n_words"].append(text.count(b" ") + 1 if text else 0)
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {s["label"] for s in spans})))
                out["score"].append(1.0 if base else max((s["similarity"] for s in spans), default=0.0))
                out["spans"].append(spans)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """-> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans), a row for each row of `docs`.

    Places of the phrases' words give the base columns (first_word and last_word
    are null without any). `spans` are the notices found within their number of
    edits, their words of EXACT unchanged, as (label, start, end, similarity) in
    bytes of the normalised text; `labels` joins both kinds. score is 1 for a base
    phrase, else the best similarity, 1 - edits / length, else 0.

    A null, empty or wordless text has no words, no labels, score 0. A text is
    searched whole, however long. Rows may repeat and doc_id may be null; other
    columns are ignored.
    """
    return texts(docs).mapInArrow(
        _scan(phrases, notices),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,start:long,end:long,similarity:double>>",
    )


def op8_fuzzy_notices(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
