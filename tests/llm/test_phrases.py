from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from catalogspark.llm import phrases

CAPITALS = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CAPITALS)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain(docs, least=30, longest=4, top=2000, inside=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            if any(
                len(q) > len(p) and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, c in often.items()
            ):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def rows(df):
    return [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


@pytest.fixture(scope="module")
def said(spark):
    r = random.Random(5)
    words = ["new", "York", "city", "of", "the", "a", "日本", "x\x00y", " ", "(b)", "don't", "in"]
    say = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r", "\x0b"]) for _ in range(n))
    passage = say(60)
    docs = [(r.choice(["en", "de", None, "und"]), say(r.randint(0, 80))) for _ in range(120)]
    docs += [("en", passage + say(5)) for _ in range(40)] + [(None, None), ("de", ""), ("fr", "a b"), ("en", say(6000)), ("en", "the " * 3000)]
    docs += [("one", "only one"), ("one", " . , ! ")]
    schema = "lang string, text string, n int, phrase string, score double, a int, l string, k int"
    return spark.createDataFrame([(*d, 1, "p", 1.0, 2, "l", 3) for d in docs], schema).repartition(4), docs


@pytest.mark.parametrize("every, most, bits", [(24, 256, 27), (2, 3, 10), (1, 1, 8), (10**9, 7, 20)])
def test_against_plain(said, every, most, bits):
    df, docs = said
    for least, top in ((30, 2000), (5, 50)):
        got = rows(phrases.collocations(df, least=least, top=top, every=every, most=most, bits=bits))
        assert len(got) == len(set(got)) and set(got) == plain(docs, least, top=top)


def test_dictionary_holds_each_word_once(said):
    df, docs = said
    chunks = phrases.dictionary(df).collect()
    assert sum(c.owned * c.frequency for c in chunks) == sum(len(w) for _, t in docs for w in pieces(t))
    assert all(1 <= c.owned <= phrases.MOST for c in chunks)
    assert len(chunks) < sum(c.frequency for c in chunks)  # passages are cut alike


def test_longer_phrases_and_empty(said, none):
    df, docs = said
    assert set(rows(phrases.collocations(df, least=20, longest=6))) == plain(docs, 20, longest=6)
    assert rows(phrases.collocations(df, least=20, longest=1)) == []
    assert rows(phrases.collocations(none)) == []
    assert rows(phrases.collocations(df, least=10**12)) == []
