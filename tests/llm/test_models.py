"""Language, search, URLs and licences against brute force or held-out rows."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import regex

from catalogspark.llm import language, licenses, queries, topk, urls

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    got = queries.QUERIES["op3_naive_bayes"](spark, SF).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    fair = [r for r in got if r.held_out and len(lang[r.doc_id][1]) >= 40]
    right = sum(r.lang_pred == lang[r.doc_id][0] for r in fair)
    assert len(fair) > 150 and right >= 0.97 * len(fair)
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_documents(spark, odd, none):
    got = language.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (5, 6, 7, 12))
    assert all(by[i].lang_pred in ("en", "fr") for i in (1, 8, 11, 14))
    assert not by[None].held_out
    unlabelled = odd.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    assert language.identify(none).collect() == []


def test_long_texts_are_scored_whole(spark, monkeypatch):
    rows = [(1, "the thing of that " * 400, "en"), (4, "der die das und ich " * 400, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    test = spark.createDataFrame([(9, "the " + "und der ich " * 3000)], "doc_id long, text string")
    monkeypatch.setattr(language, "CHARS", 100)
    assert language.predict(test, model).first().lang_pred == "de"


def test_cut_texts_keep_all_their_ngrams(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choices("abcÄßé  .,\n1漢字ªΣ", k=r.randrange(1, 90))) for _ in range(300)]
    whole = [np.sort(language._grams([t])[0]).tolist() for t in texts]
    for size in (1, 2, 3, 7, 40):
        monkeypatch.setattr(language, "CHARS", size)
        for text, want in zip(texts, whole):
            got = [b for found in language._long_grams(text) for b in found.tolist()]
            assert sorted(got) == want


def test_many_languages_come_in_blocks(spark, monkeypatch):
    """Block after block gives what one matrix of all languages gives."""
    r = random.Random(6)
    rows = [(i, "".join(r.choices("abcdefgh "[k % 5 : k % 5 + 4 + k % 3], k=60)), f"l{k}") for i, k in enumerate(list(range(12)) * 3)]
    df = spark.createDataFrame(rows + [(99, "  ", None)], "doc_id long, text string, lang string").repartition(3)
    want = {g.doc_id: g for g in language.identify(df).collect()}
    monkeypatch.setattr(language, "BLOCK", 3)
    assert language.train(df).blocks == 4 and language.train(df).languages == 12
    got = {g.doc_id: g for g in language.identify(df).collect()}
    assert len({g.lang_pred for g in got.values()}) > 6
    for k, g in got.items():
        assert g.lang_pred == want[k].lang_pred and abs(g.score - want[k].score) < 1e-9


def products(rows, every, k, scale):
    fit = []
    for i, (vec_id, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            fit.append((i, vec_id, [int(np.floor(scale * float(x))) for x in v]))
    out = []
    for i, query, q in fit:
        if query is not None and query % every == 0:
            scores = sorted(
                (-sum(a * b for a, b in zip(q, v)), vec_id is None, vec_id or 0) for j, vec_id, v in fit if j != i
            )[:k]
            out += [(query, n + 1, None if none else vec_id, -s) for n, (s, none, vec_id) in enumerate(scores)]
    return sorted(out, key=repr)


def test_products_of_odd_vectors(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)] + [(50, [0.25] * 6), (None, [9.0] * 6), (None, None), (501, None)]
    rows += [(502, [1.0, None]), (550, [float("nan")] * 6), (503, [float("inf")]), (600, []), (650, [2.0]), (-50, [-1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS row", "2 AS v").repartition(4)
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for first in (1024, 1):
        monkeypatch.setattr(topk, "FIRST", first)
        got = sorted(map(tuple, topk.top_products(df).collect()), key=repr)
        assert got == products(rows, 50, 5, 256)
    few = spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")
    assert topk.top_products(few).collect() == []
    assert topk.top_products(few.limit(0)).collect() == []


def test_products_of_large_vectors(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(200)]
    rows += [(200 + i, (r.normal(size=6) * 10.0 ** r.integers(4, 7)).tolist()) for i in range(100)]
    rows += [(300, [-1e7, 2e7, 5.0]), (301, [1e18, 1e18, 1.0, 2.0]), (302, [1e25])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    for first, last in ((1024, 301), (1, 301)):  # products of the last two are beyond a long
        monkeypatch.setattr(topk, "FIRST", first)
        own = rows[:last]
        df = spark.createDataFrame(own, "vec_id long, embedding array<float>").repartition(4)
        assert sorted(map(tuple, topk.top_products(df).collect()), key=repr) == products(own, 50, 5, 256)
    # (query, vector) pairs beyond a long count only where a result holds them
    few = [(50, [0.0, 1.0]), *[(i, [0.0, float(i)]) for i in range(1, 7)], (9, [-1e30, -1e30]), (10, [1e30, 0.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_products(df).collect()), key=repr) == products(few, 50, 5, 256)
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()


def parse(url):
    found = re.match("(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in found[2])
    return host, found[3]


def ruled(host, path):
    fits = [
        (len(own + start), own + start, said) for said, own, start in urls.RULES
        if (host == own or host.endswith("." + own)) and path.startswith(start)
    ]
    return max(fits)[1:] if fits else (None, None)


ODD_URLS = [
    None, "", "no scheme", "http://", "https://Example.NET/en/x?q#f", "http://a.example.net/en", "http://x.net", "http://x.net/",
    "http://badexample.com/de/1", "ftp://www.example.com/de/", "http://é.org/fr/ü", "a://b://c/d", "http://h?x/y", "http://h#/y",
    "http://casinowin.biz/free", "http://u:p@x.org:80/fr/", "://net/", "x\n://a.net/b\nc", "http://" + "a" * 3000 + ".biz/" + "b" * 3000,
]


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(None if i == 3 else -i, u, None) for i, u in enumerate(ODD_URLS)], pages.schema)
    both = pages.union(odd).union(odd).selectExpr("*", "1 AS host", "2 AS words", "3 AS n")
    got = urls.judge(both).collect()
    want = sorted(
        (str(r.page_id), *parse(r.url), str(ruled(*parse(r.url))[0])) for r in both.collect()
    )
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == want
    for r in got:
        said = ruled(r.host, r.path)[1]
        assert r.verdict == (said or ("block" if r.score >= 0.5 else "allow"))
    seeded = [r for r in got if not r.rule and set(r.words) & set(urls.SEEDS)]
    assert seeded and sum(r.verdict == "block" for r in seeded) >= 0.9 * len(seeded)
    assert {tuple(r.words) for r in got if not r.host and not r.path} == {()}
    assert urls.judge(pages.limit(0)).collect() == []


def test_segmentation():
    model = urls.Unigrams({"spam": 3.0, "farm": 3.0, "far": 2.9, "free": 3.0, "bets": 3.5, "a": 1.0}, 8.0)
    assert model.split("spamfarm") == ["spam", "farm"]
    assert model.split("freebets") == ["free", "bets"]
    assert model.split("xqzfree") == ["xqz", "free"]
    assert model.split("") == [] and model.split("qq") == ["qq"]


def test_names_split_alike_however_many_paths(spark):
    html = "<a href='http://casinowin.biz/'>" + "casino win spam farm the " * 200 + "http://casinowin.biz/x</a>" * 300
    rows = [(i, f"http://casinowin.biz/{i}", None) for i in range(500)]
    rows += [(1000, "http://spamfarm.biz/1", html), (1001, "http://thecasino.biz/1", None), (1002, "http://x.org/fr/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert {tuple(got[i].words[:2]) for i in range(500)} == {("casino", "win")}
    assert got[1000].words[:2] == ["spam", "farm"] and got[1001].words[:2] == ["the", "casino"]
    assert {r.verdict for i, r in got.items() if i != 1002} == {"block"}


def test_names_of_rare_words_split_whatever_the_table(spark):
    r = random.Random(6)
    many = ["jx" + "".join(r.choice("jxqvw") for _ in range(10)) for _ in range(60_000)]
    rows = [(1, "http://quokkazephyr.biz/", " ".join(many * 2) + " quokka zephyr"), (2, "http://" + "quokka" * 500, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.words for r in urls.judge(df).collect()}
    assert got[1][:2] == ["quokka", "zephyr"] and got[2] == ["quokka"]


def test_licences(spark, odd, none):
    r = random.Random(4)
    texts = [(t.doc_id, t.text) for t in odd.collect()]
    for i, notice in enumerate(licenses.NOTICES):
        for edits in range(4):
            spoiled = list(notice)
            for _ in range(edits):
                spoiled[r.randrange(len(spoiled))] = r.choice("qxz")
            texts.append((2000 + 10 * i + edits, f"some words, {''.join(spoiled).title()}. And more MIT license"[: 60 + 30 * edits]))
    texts.append((3000, "mit license " * 5000 + "MIT\x00Apache License; general PUBLIC-license"))
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS spans").repartition(3)
    got = {g.doc_id: g for g in licenses.scan_licenses(df).collect()}
    for doc, text in texts:
        if doc is None or doc == 2:
            continue
        words = licenses.normal(text).decode().split(" ") if licenses.normal(text) else []
        assert words == [
            w for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        ]
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            sought = phrase.split(" ")
            own = [i for i in range(len(words)) if words[i : i + len(sought)] == sought]
            places += own
            base |= {label} if own else set()
        g = got[doc]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (
            len(words), len(places), min(places, default=None), max(places, default=None)
        )
        labels = set(base)
        whole = " ".join(words)
        if len(whole) < 5000:
            for notice, label in licenses.NOTICES.items():
                pattern = rf"(?be)(?<![^ ])(?:{regex.escape(notice, special_only=True)}){{e<={len(notice) // 9}}}(?![^ ])"
                found = regex.search(pattern, whole)
                labels |= {label} if found and found.end() > found.start() else set()
            assert g.labels == ",".join(sorted(labels)), text
        assert g.base_labels == ",".join(sorted(base)) and 0 <= g.score <= 1
        for s in g.spans:
            assert 0 <= s.start < s.end <= len(licenses.normal(text))
    assert licenses.scan_licenses(none).collect() == []


def test_other_licences_are_not_taken_for_known_ones(spark):
    rows = [
        ("released under the bsd license", ""), ("released under the gpl license", ""), ("released under the isc license", ""),
        ("licensed under cc by sa", ""), ("licensed under cc by nd 4 0", ""), ("licensed under cc by 4 0", ""), ("licensed under cc by", ""),
        ("Releasd under tha MIT license", "mit"), ("released under the mit licence", "mit"), ("Licensd unter CC BY-NC", "cc-by-nc"),
        ("released under the bsd license, or released under the mit licens", "mit"), ("released under the permit license", ""),
    ]
    df = spark.createDataFrame([(i, f"a b {t}") for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {g.doc_id: g for g in licenses.scan_licenses(df).collect()}
    assert [got[i].labels for i in range(len(rows))] == [want for _, want in rows]
    assert all((got[i].score > 0) == bool(want) for i, (_, want) in enumerate(rows))


def test_every_notice_of_a_text_has_its_span(spark):
    rows = [(1, "all rigths reserved all rights reserved"), (2, "all rigths reserved by us, " * 20_000), (3, "all rights reserved " * 3)]
    got = {g.doc_id: g.spans for g in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.end, s.similarity) for s in got[1]] == [(0, 19, 1 - 2 / 19), (20, 39, 1.0)]
    assert [s.start for s in got[2]] == [26 * i for i in range(20_000)]
    assert [(s.start, s.end) for s in got[3]] == [(0, 19), (20, 39), (40, 59)]
