from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalogspark.functions import iri
from catalogspark.operators import decode, encode
from catalogspark.schema import NS, QUADS
from catalogspark.session import cut
from tests.build import Builder, canonical, permit


def rich(spark):
    b = Builder(spark)
    b.catalog("node/1 ü", "cat 1", "did:web:p", **{"http://purl.org/dc/terms/title": "T", "plain key": "v"})
    b.service("node/1 ü", "svc/1", "https://a.example/dsp", "dsp:1.0")
    b.service("node/1 ü", "svc*2~", "not an iri")
    policy = {
        "id": "p1", "kind": "Offer", "assigner": "did:web:x", "assignee": "some one",
        "permission": [
            {"constraints": [("odrl:dateTime", "lteq", "2027-01-01"), ("count", "eq", "3")]},
            {"action": "use"},
        ],
        "prohibition": [{"constraints": [
            {"xone": [("a", "eq", "1"), {"and": []}, {"andSequence": [{"or": [("b", "neq", "2")]}]}]},
        ]}],
        "obligation": [{"action": "urn:x"}],
    }
    b.dataset("node/1 ü", "ds/1", [("json", "svc/1"), ("csv", "ghost")], [policy, {}], title="A")
    b.dataset("node/1 ü", "", [("", "")], [])
    b.catalog("node-2", "cat 1")
    b.dataset("node-2", "only", policies=[permit()])
    return b.tables()


def test_round_trip_is_exact(spark):
    tables = rich(spark)
    back, failed = decode.decode_with_errors(cut(encode.encode(tables)))
    assert failed.count() == 0
    for name, df in vars(tables).items():
        assert canonical(df) == canonical(getattr(back, name).select(df.columns)), name


def test_quads_are_a_set_and_right_operands_stay_literal(spark):
    quads = cut(encode.encode(rich(spark)))
    assert quads.count() == quads.distinct().count()
    kinds = quads.filter(F.col("p").endswith("rightOperand")).select("o_kind").distinct().collect()
    assert [k.o_kind for k in kinds] == ["literal"]
    urls = {r.o: r.o_kind for r in quads.filter(F.col("p").endswith("endpointURL")).collect()}
    assert urls == {"https://a.example/dsp": "iri", "not an iri": "literal"}


def nested(depth):
    constraint = ("a", "eq", "1")
    for _ in range(depth):
        constraint = {"and": [constraint]}
    return constraint


def test_over_deep_catalog_is_refused_and_others_kept(spark):
    b = Builder(spark)
    for node, depth in (("ok", 64), ("deep", 65)):
        b.catalog(node)
        b.dataset(node, "d", policies=[permit(nested(depth))])
    tables = b.tables()
    refused = encode.refused_nodes(tables.constraints).collect()
    assert [r.node_id for r in refused] == ["deep"]
    graphs = encode.encode(tables).select("graph").distinct().collect()
    assert [g.graph for g in graphs] == [NS.nodes + "ok"]


def test_undecodable_graphs_are_skipped_or_raised(spark):
    b = Builder(spark)
    for node in ("good", "index", "format", "marker"):
        b.catalog(node)
        b.service(node, "s")
        b.dataset(node, "d", [("json", "s")], [permit({"and": [("a", "eq", "1")]})])
    graph, s, p = F.col("graph"), F.col("s"), F.col("p")
    at = lambda node: graph == NS.nodes + node
    group = NS.nodes + "marker/datasets/d/policies/0/permissions/0/constraints/0"
    wrong = (NS.nodes + "marker", group, NS.logical_operator, "http://www.w3.org/ns/odrl/2/or",
             "iri", "", "")
    quads = cut(
        encode.encode(b.tables())
        .filter(~(at("index") & (p == NS.sequence_index) & s.endswith("/services/s")))
        .filter(~(at("format") & p.endswith("format")))
        .filter(~(at("marker") & (p == NS.logical_operator)))
        .unionByName(spark.createDataFrame([wrong], QUADS))
    )
    tables, failed = decode.decode_with_errors(quads)
    assert sorted(r.graph for r in failed.collect()) == [
        NS.nodes + n for n in ("format", "index", "marker")
    ]
    assert [r.node_id for r in tables.datasets.collect()] == ["good"]
    with pytest.raises(decode.UndecodableGraph):
        decode.decode_node(quads, "format")


def test_group_without_marker_reads_the_first_linked_combinator(spark):
    b = Builder(spark)
    b.catalog("n")
    b.dataset("n", "d", policies=[permit({"or": [("a", "eq", "1")]})])
    quads = cut(encode.encode(b.tables())).filter(F.col("p") != NS.logical_operator)
    ops = {tuple(r.path): r.op for r in decode.decode(quads).constraints.collect()}
    assert ops == {(0,): "or", (0, 0): "atomic"}


def test_iri_helpers(spark):
    rows = spark.createDataFrame(
        [("a b/c",), ("é~*+",), ("",), ("-_.",)], "x string"
    ).select(
        "x", iri.encode_id(F.col("x")).alias("e"), iri.decode_id(iri.encode_id(F.col("x"))).alias("d")
    ).collect()
    assert {r.x: r.e for r in rows} == {
        "a b/c": "a%20b%2Fc", "é~*+": "%C3%A9~%2A%2B", "": "", "-_.": "-_."
    }
    assert all(r.x == r.d for r in rows)
    base = NS.nodes + "node%2Fa"
    cases = {
        f"{base}/datasets/ds%2F1": f"{base}/datasets/ds%2F1",
        f"{base}/datasets/ds%2F1/policies/0/permissions/0": f"{base}/datasets/ds%2F1",
        f"{base}/datasets/": f"{base}/datasets/",
        f"{base}/datasets//distributions/0": f"{base}/datasets/",
        f"{base}/services/s": f"{base}/services/s",
        f"{base}/datasets": f"{base}/datasets",
        f"{base}/other/x": f"{base}/other/x",
        base: None,
        f"{base}/catalogs/cat%2Fdatasets%2Fx": None,
        f"{base}/catalogs": None,
        "http://www.w3.org/ns/dcat#Dataset": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "i string").select(
        "i", iri.owning_resource(F.col("i")).alias("o")
    ).collect()
    assert {r.i: r.o for r in got} == cases
    texts = ["did:web:x", "https://a/b?c#d", "no scheme", "1a:b", "a:b c", "a:", "urn:x:\u00e9"]
    flags = spark.createDataFrame([(t,) for t in texts], "t string").select(
        iri.is_iri(F.col("t")).alias("f")).collect()
    assert [r.f for r in flags] == [True, True, False, False, False, True, True]
    keys = ["plain key", "http://x/y", "a%b"]
    back = spark.createDataFrame([(k,) for k in keys], "k string").select(
        iri.property_key(iri.property_predicate(F.col("k"))).alias("b")).collect()
    assert [r.b for r in back] == keys
