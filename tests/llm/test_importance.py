from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from catalogspark.llm import importance
from catalogspark.llm.importance import PositionTable

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(CAPITALS))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, least=20, percent=5):
    """(doc_id, n_features, weight, score, rank) of each row, by the contract."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, text in docs for f in features(text)[1])
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out, eligible = [], []
    for i, (doc, text) in enumerate(docs):
        words, own = features(text)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None])
        if len(words) >= least:
            eligible.append(i)
    eligible.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for rank, i in enumerate(eligible[: percent * len(eligible) // 100]):
        out[i][4] = rank + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("reach", [4, 16, 256])
def test_crc_of_spans(reach):
    r = random.Random(reach)
    data = np.frombuffer(r.randbytes(20_000), np.uint8)
    starts = np.array([r.randrange(15_000) for _ in range(400)])
    ends = starts + np.array([r.choice([1, 2, 3, 4, 5, 15, 16, 17, 255, 256, 257, 511, 512, 513, 4999]) for _ in starts])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert PositionTable(reach).crc32(data, starts, ends).tolist() == want


def test_against_plain(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    target = ["alpha beta gamma", "the of and", None, "", "délta x1"]
    items = spark.createDataFrame([(i, t, "w") for i, t in enumerate(target)], "item_id long, text string, weight string")
    for percent, least in ((5, 20), (50, 1), (100, 0)):
        got = importance.importance(odd, items, percent=percent, least_words=least)
        got = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect())
        want = plain(rows, target, least, percent)
        # equal rows may take each other's ranks
        assert Counter(k[:4] for k in got.elements()) == Counter(k[:4] for k in want.elements())
        assert sorted(k[4] for k in got.elements() if k[4]) == sorted(k[4] for k in want.elements() if k[4])
        ids = Counter(k[0] for k in want)
        once = lambda c: {k for k in c if ids[k[0]] == 1}
        assert once(got) == once(want)


def test_sf(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = importance.op12_position_crc(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain([(r.doc_id, r.text) for r in docs.collect()], target)


def test_long_words_and_texts(spark):
    r = random.Random(9)
    texts = ["z" * 100_000 + " a " + "y" * 300, " ".join("".join(r.choices("abcé", k=r.randint(1, 700))) for _ in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = importance.importance(docs, docs.limit(1), percent=100)
    want = plain(list(enumerate(texts)), texts[:1], percent=100)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()) == want


def test_resample_and_empty(spark, none, odd):
    assert importance.importance(none, none).count() == 0
    items = spark.createDataFrame([("the of and",)], "text string")
    drawn = importance.importance(odd, items, percent=30).filter("rank is not null")
    ids = {r.doc_id for r in drawn.collect()}
    kept = importance.resample(odd, items, percent=30)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == ids and ids
    assert importance.importance(odd, none).filter("rank is not null").count() > 0
