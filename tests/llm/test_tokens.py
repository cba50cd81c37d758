"""Token files, counts and packing against the library's own ids."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from catalogspark.llm import counts, encode, packing, wavelet
from catalogspark.llm.encode import Encoder, tokenizer_path
from catalogspark.llm.frames import new_path


def library(name):
    own = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "", " ", "a", " lead", "trail ", "a  b\n c", "x \n y\t\tz 's 'S 1234 ½", "don't. they're, ('s) 's.", "É́ x　y ,, Hi!!",
    "Σας ΟΔΟΣ. é, 9, a.b, x' y's.", "a\x1cb \x1c c\x85d \x85 e", "x" * 200 + " " + "y" * 100 + ", " + "z" * 70 + ".",
    "<|endoftext|>x <|ENDOFTEXT|> <|StartOfText|>", "İ. ẞ ß ŉ word.\nNext, line.\n\nend", "a\nb\nc", "\nb", "é. a ́ b", None,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_librarys_ids(name):
    ids, own = library(name), Encoder(tokenizer_path(name))
    for _ in range(2):  # the second time from the cache
        for text, got in zip(TEXTS, own.encode(TEXTS)):
            assert np.frombuffer(got, "<u4").tolist() == ids(text), text


@pytest.mark.parametrize("values", [[], [0], [5], [7] * 1300, list(range(600)) * 3, [49407, 0, 2, 49407] * 999, [70_000, 1]])
def test_wavelet_access_rank_select(values):
    ids = np.array(values, np.uint32)
    shard = wavelet.Shard(wavelet.build([3, None], [len(values), 0], ids))
    assert shard.doc_ids == [3, None] and shard.first.tolist() == [0, len(values), len(values)]
    assert shard.ids().tolist() == values
    places = defaultdict(list)
    for at, value in enumerate(values):
        places[value].append(at)
    for at in range(0, len(values), 97):
        assert shard.access(at) == values[at]
    for token in [*list(places)[:9], 123_456_789, 1]:
        assert shard.count(token) == len(places[token])
        assert shard.count(token, 3, max(3, len(values) - 5)) == sum(3 <= p < len(values) - 5 for p in places[token])
        for k in range(0, len(places[token]), 401):
            assert shard.locate(token, k) == places[token][k]
        with pytest.raises(IndexError):
            shard.locate(token, len(places[token]))


def test_wavelet_files(spark, odd, none, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 500)
    ids, path = library("word_bpe_49k.json"), new_path(spark, "wavelet")
    wavelet.write_shards(odd, path, shards=3)
    got = wavelet.read_documents(spark, path).collect()
    tied = [r.text for r in odd.selectExpr("*", "xxhash64(text) AS h").orderBy("h").collect()]  # order of equal ids
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, tied.index(r.text)))
    start, want = 0, []
    for row in rows:
        own = np.array([*ids(row.text), 2], "<u4")
        want.append((row.doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, [r[:4] for r in got]), key=lambda r: r[1]) == want
    assert len({(r["range"], r["number"]) for r in got}) > 3
    empty = new_path(spark, "wavelet")
    wavelet.write_shards(none, empty)
    assert wavelet.read_documents(spark, empty).collect() == []


def test_counts_and_cache(spark, odd, none):
    cache, ids = new_path(spark, "counts"), library("word_bpe_49k.json")
    want = sorted(((r.doc_id or -9, len((r.text or "").encode()), len(ids(r.text))) for r in odd.collect()))
    for _ in range(2):
        got = counts.count_tokens(odd, cache, limit=30).collect()
        assert sorted((r.doc_id or -9, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 30) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # nothing was counted twice
    assert counts.count_tokens(none, new_path(spark, "counts")).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(spark, odd, name):
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        ids = lambda text: own.encode(text or "")
    else:
        ids = library(name)
    got = counts.count_tokens(odd, new_path(spark, "counts"), name).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(ids(r.text)) for r in odd.collect())


def check_packing(rows, docs, length, ids):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.length > 0
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0
    whole = defaultdict(list)
    for doc, text in docs:
        whole[doc].append(np.array([*ids(text), 0], "<u4").tobytes())
    for doc, own in pieces.items():
        if len(whole[doc]) == 1:
            own.sort(key=lambda r: r.start)
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
            assert b"".join(r.ids for r in own) == whole[doc][0] and own[0].doc_tokens == len(whole[doc][0]) // 4
    assert set(pieces) == set(whole)
    assert sum(r.length for r in rows) == sum(len(t) // 4 for own in whole.values() for t in own)


def test_packing(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    check_packing(packing.pack(odd, length=64).collect(), docs, 64, library("byte_bpe_50k.json"))
    assert packing.pack(none).collect() == []


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        places = packing.hilbert(cells, bits)
        assert sorted(places.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(places)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_marked_and_mixed_case_texts(name, monkeypatch):
    """Capitals, combining marks and odd blanks, against the library; a small cache
    is turned over many times."""
    monkeypatch.setattr(encode, "CACHE_BYTES", 200_000)
    r = random.Random(17)
    letters = "thjwyaeizsTHJWYAEIZSKſΣςİıﬁßÅ"
    marks = "゙̧̣̱̀́̂̇̈̊̌᷄⃐ͅ"
    blanks = [" ", " ", " ", "  ", "\n", "\t", " ", " ", "　", "'", ".", "'S ", "1", "<|", ""]

    def one():
        out = []
        for _ in range(r.randint(1, 6)):
            for _ in range(r.randint(1, 4)):
                out += [r.choice(letters), *r.choices(marks, k=r.choice([0, 0, 0, 1, 1, 2]))]
            out.append(r.choice(blanks))
        return "".join(out)

    texts = ["H̱ J̌ W̊ Y̊", "T̈", *[one() for _ in range(50_000)]]
    want = list(map(library(name), texts))
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encode.Encoder(encode.tokenizer_path(name)).encode(texts)]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []
