"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from catalogspark.llm import language, queries
from catalogspark.llm.frames import new_path
from tests.check import compare, connect
from tests.llm.test_sets import near, passages, template_lines
from tests.llm.test_tokens import check_packing, library

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_sql(spark, name):
    ok, detail = compare(spark, connect(SF), name, SF)
    assert ok, detail


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, before, SF).write.parquet(path)
        out[name] = spark.read.parquet(path)
        if name != "packing":
            assert sorted(out[name].dtypes) == sorted(docs.dtypes)
        before = out[name]
    ids = {name: {r.doc_id for r in df.collect()} for name, df in out.items()}
    first = {r.doc_id: r.text for r in docs.collect()}
    # language: only documents that the operator rejects go
    judged = {r.doc_id: r for r in language.identify(docs).collect()}
    assert ids["language"] == {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SCORE}
    kept = [(r.doc_id, r.text) for r in out["language"].collect()]
    # lines
    changed = {doc: (dropped, text) for doc, _, dropped, text in template_lines(kept)}
    want = {doc: text for doc, (dropped, text) in changed.items() if not dropped or text}
    now = {str(r.doc_id): r.text for r in out["lines"].collect()}
    assert now == want and any(d for d, _ in changed.values())
    assert all(r.n_chars == len(r.text) for r in out["lines"].collect())
    # near copies: the smallest of each group
    rows = [(r.doc_id, r.text) for r in out["lines"].collect()]
    assert {str(i) for i in ids["near_copies"]} == {comp for _, _, comp in near([(d, t) for d, t in rows], 5, 80) if comp != "None"}
    # benchmark passages
    rows = [(r.doc_id, r.text) for r in out["near_copies"].collect()]
    assert {str(i) for i in ids["benchmarks"]} == {p[0] for p in passages(rows, items) if not p[5]}
    docs_left = [(r.doc_id, r.text) for r in out["benchmarks"].collect()]
    check_packing(out["packing"].collect(), docs_left, 1024, library("byte_bpe_50k.json"))
    assert set(first) >= ids["packing"]


def test_pipeline_of_odd_documents(spark, odd, none):
    for docs in (odd, none):
        before = docs
        for name, stage in corpus_pipeline.STAGES:
            path = new_path(spark, "odd")
            stage(spark, before, SF).write.parquet(path)
            after = spark.read.parquet(path)
            if name != "packing":
                assert sorted(after.columns) == sorted(docs.columns)
                assert after.count() <= before.count()
            before = after
