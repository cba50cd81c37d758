from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import encode, visibility
from catalogspark.operators import pattern as P
from catalogspark.operators.pattern import Graph, Solutions, text
from catalogspark.operators.policy import entitle
from catalogspark.schema import DCAT, NS, QUADS, RDF_TYPE, XSD_INTEGER
from catalogspark.session import cut
from catalogspark.sources import quads as Q
from catalogspark.sources import sinks
from tests.build import Builder, canonical, permit

GATE = permit(("role", "eq", "eu"))


@pytest.fixture(scope="module")
def tables(spark):
    b = Builder(spark)
    b.catalog("a", "cat-a", **{"k": "v"})
    b.service("a", "shared", "https://shared.example/")
    b.service("a", "gated-svc", "https://secret.example/")
    b.service("a", "unused")
    b.dataset("a", "OPEN", [("json", "shared"), ("csv", "ghost")], title="open")
    b.dataset("a", "GATED", [("json", "shared"), ("xml", "gated-svc")], [GATE], title="SECRET")
    b.dataset("a", "", [("json", "")], [GATE], title="SECRET")
    b.dataset("a", "PLAIN", title="plain")
    b.catalog("b", "cat-b")
    b.dataset("b", "ONLY", policies=[GATE], title="SECRET")
    return b.tables()


@pytest.fixture(scope="module")
def quads(tables):
    return cut(encode.encode(tables))


def allowed(spark, tables, claims):
    classes = spark.createDataFrame([("me", claims)], "class_key string, claims map<string,array<string>>")
    return cut(visibility.allow_list(tables, entitle(tables, classes)))


def shapes(g: Graph):
    node = NS.nodes + "a"
    ds = lambda: g.match("?s", RDF_TYPE, DCAT + "Dataset")
    return {
        "all": g.match("?s", "?p", "?o").filter(F.col("p.value") != NS.sequence_index),
        "graph var": g.match("?s", RDF_TYPE, DCAT + "Dataset", g="?g"),
        "graphs": g.graphs(),
        "one graph": g.match("?s", RDF_TYPE, DCAT + "Dataset", g=node),
        "from": g.over(default=[node]).match("?s", RDF_TYPE, DCAT + "Distribution"),
        "from named": g.over(named=[node]).graphs(),
        "count": ds().optional(g.match("?s", DCAT + "distribution", "?x")).group_by("s", n=P.count("x")),
        "path": Solutions(g.path("?s", DCAT + "dataset", "?m").join(
            g.closure("?m", DCAT + "distribution", "?o")).df.select("s", "o").distinct()),
        "minus": ds().minus(g.match("?s", DCAT + "distribution", "?x")),
        "union": ds().union(g.match("?v", DCAT + "endpointURL", "?u")),
        "bgp": g.patterns(("?c", DCAT + "dataset", "?d"), ("?d", DCAT + "distribution", "?x"),
                          ("?x", DCAT + "accessService", "?v")),
    }


def test_restricted_equals_unrestricted_when_all_is_visible(spark, tables, quads):
    everything = allowed(spark, tables, {"role": ["eu"]})
    iris = {r.iri for r in everything.collect()}
    assert len(iris) == 5 + 3
    # A link to a service nobody lists is not on the list, and neither is the empty id.
    ghosts = [f"{NS.nodes}a/services/ghost", f"{NS.nodes}a/services/"]
    listed = everything.select("iri").unionByName(spark.createDataFrame([(g,) for g in ghosts], "iri string"))
    got = shapes(Graph(cut(visibility.visible_quads(quads, listed))))
    for name, want in shapes(Graph(quads)).items():
        assert canonical(got[name].df) == canonical(want.df), name


def test_hidden_content_cannot_be_reached(spark, tables, quads):
    mine = allowed(spark, tables, {})
    assert {r.iri.removeprefix(NS.nodes) for r in mine.collect()} == {
        "a/datasets/OPEN", "a/datasets/PLAIN", "a/services/shared", "a/services/unused"}
    shown = cut(visibility.visible_quads(quads, mine))
    flat = json.dumps([r.asDict() for r in shown.collect()])
    for secret in ("SECRET", "GATED", "ONLY", "secret.example", "ghost", "sequenceIndex", "/datasets/\""):
        assert secret not in flat, secret
    assert f"{NS.nodes}b/catalogs/cat-b" in flat
    assert Graph(shown).match("?d", NS.property_prefix + "title", text("SECRET")).ask() is False


def test_filtered_tables(spark, tables):
    classes = spark.createDataFrame([("me", {})], "class_key string, claims map<string,array<string>>")
    seen = cut(entitle(tables, classes).visible())
    shown = visibility.filter_catalogs(tables, seen)
    assert {r.dataset_id for r in shown.datasets.collect()} == {"OPEN", "PLAIN"}
    assert {r.service_id for r in shown.services.collect()} == {"shared", "unused"}
    assert shown.catalogs.count() == 2
    kept = visibility.filter_catalogs(tables, seen, keep_all_services=True)
    assert kept.services.count() == 3
    assert visibility.should_filter(True) and not visibility.should_filter(False, False)


def test_only_changed_nodes_are_rebuilt(spark, tables):
    classes = spark.createDataFrame([("me", {})], "class_key string, claims map<string,array<string>>")
    entitled = entitle(tables, classes)
    before = cut(visibility.node_hashes(tables, entitled.members))
    new = tables.map(lambda n, df: df.filter("dataset_id <> 'ONLY'") if "dataset_id" in df.columns else df)
    later = entitle(new, classes)
    now = cut(visibility.node_hashes(new, later.members))
    # Node b lost its only dataset, so it has no content left to hash.
    assert visibility.changed_nodes(before, now).count() == 0
    assert {r.node_id for r in now.collect()} == {"a"}
    start = cut(visibility.allow_list(tables, entitled))
    built = []

    def fresh(nodes):
        built.extend(r.node_id for r in nodes.collect())
        return visibility.allow_list(new, later).join(nodes, "node_id", "left_semi")

    out = visibility.refresh_allow_list(start, before, fresh, now)
    assert built == [] and canonical(out) == canonical(visibility.allow_list(new, later))


# Algebra over random solutions, checked against its definition ----------------


def term(v):
    return None if v is None else (v, "iri", "", "")


def make(spark, names, rows):
    schema = ", ".join(f"{n} {P.TERM}" for n in names)
    df = spark.createDataFrame([tuple(term(v) for v in r) for r in rows], schema)
    maybe = {n for i, n in enumerate(names) if any(r[i] is None for r in rows)}
    return Solutions(df, frozenset(maybe))


def rows_of(solutions, names):
    return sorted(
        tuple(r[n].value if r[n] else "-" for n in names) for r in solutions.df.collect()
    )


def compatible(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


def test_joins_with_unbound_variables(spark):
    left = [("1", "a", None), ("2", None, "x"), ("2", "b", "y"), ("3", "b", None), ("3", "b", None)]
    right = [("a", "x", "p"), ("b", None, "q"), (None, "y", "r"), ("b", "y", "s")]
    ls, rs = make(spark, "ijk", left), make(spark, "jkm", right)
    bind = lambda names, r: {n: v for n, v in zip(names, r) if v is not None}
    L, R = [bind("ijk", r) for r in left], [bind("jkm", r) for r in right]
    show = lambda d, names="ijkm": tuple(d.get(n, "-") for n in names)
    joined = [{**a, **b} for a, b in itertools.product(L, R) if compatible(a, b)]
    assert rows_of(ls.join(rs), "ijkm") == sorted(map(show, joined))
    alone = [a for a in L if not any(compatible(a, b) for b in R)]
    assert rows_of(ls.optional(rs), "ijkm") == sorted(map(show, joined + alone))
    lost = [a for a in L if not any(compatible(a, b) and a.keys() & b.keys() for b in R)]
    assert rows_of(ls.minus(rs), "ijk") == sorted(show(a, "ijk") for a in lost)
    found = [a for a in L if any(compatible(a, b) for b in R)]
    assert rows_of(ls.exists(rs), "ijk") == sorted(show(a, "ijk") for a in found)
    assert rows_of(ls.not_exists(rs), "ijk") == sorted(show(a, "ijk") for a in alone)
    other = make(spark, "z", [("1",)])
    assert ls.minus(other) is ls
    with pytest.raises(P.UnboundedProduct):  # no shared variable, of whatever size
        ls.join(other)
    assert ls.values(["z"], [("urn:1",), ("urn:2",)]).df.count() == 10  # inline values are a lookup


def test_products_and_large_results_are_refused(spark):
    a, b = make(spark, "a", [("1",), ("2",), ("3",)]), make(spark, "b", [("1",), ("2",), ("3",)])
    with pytest.raises(P.UnboundedProduct):
        a.join(b)
    with pytest.raises(P.TooManyRows):
        a.capped(2)
    assert a.capped(3).ask()


def edges(spark, pairs, p="urn:e"):
    return spark.createDataFrame([("g", a, p, b, "iri", "", "") for a, b in pairs], QUADS)


def test_closure_and_paths(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("d", "e")]
    g = Graph(edges(spark, pairs))
    reach = {n: {n} for n in "abcdex"}
    for _ in reach:
        for a, b in pairs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    got = rows_of(g.closure("?s", "urn:e", "?o"), "so")
    assert got == sorted((s, o) for s, os in reach.items() for o in os)
    plus = rows_of(g.closure("?s", "urn:e", "?o", zero=False), "so")
    assert ("a", "a") in plus and ("d", "d") not in plus and ("e", "e") not in plus
    assert rows_of(g.closure("d", "urn:e", "?o"), "o") == [("d",), ("e",)]
    assert rows_of(g.closure("nowhere", "urn:e", "?o"), "o") == [("nowhere",)]
    assert rows_of(g.closure("?n", "urn:e", "?n", zero=False), "n") == [("a",), ("b",), ("c",), ("x",)]
    assert rows_of(g.path("?s", ("^", "urn:e"), "a"), "s") == [("b",)]
    assert rows_of(g.path("a", ("/", "urn:e", ("^", "urn:e")), "?o"), "o") == [("a",)]
    assert ("a", "a") in rows_of(g.path("?s", ("?", "urn:e"), "?o"), "so")
    assert len(rows_of(g.path("?s", ("|", "urn:e", "urn:e"), "?o"), "so")) == 2 * len(pairs)


def test_terms_filters_and_aggregates(spark):
    rows = [("g", "s1", "n", "2", "literal", XSD_INTEGER, ""), ("g", "s2", "n", "10", "literal", XSD_INTEGER, ""),
            ("g", "s3", "n", "x", "literal", "http://www.w3.org/2001/XMLSchema#string", ""),
            ("g", "s1", "same", "s1", "iri", "", ""), ("g", "s2", "same", "s1", "iri", "", ""),
            ("h", "s1", "n", "2", "literal", XSD_INTEGER, "")]
    q = spark.createDataFrame(rows, QUADS)
    g = Graph(q, distinct_triples=True)
    nums = g.match("?s", "n", "?v")
    assert nums.df.count() == 3 and Graph(q).match("?s", "n", "?v").df.count() == 4
    assert rows_of(g.match("?x", "same", "?x"), "x") == [("s1",)]
    assert rows_of(nums.filter(P.number("v") > 3), "s") == [("s2",)]
    assert rows_of(nums.filter(P.is_in("v", text("2", XSD_INTEGER), text("x"))), "s") == [("s1",), ("s3",)]
    assert rows_of(g.match("?s", "n", text("2")), "s") == []  # compared as written, type included
    ints = nums.filter(P.number("v").isNotNull())
    out = ints.group_by(t=P.sum_("v"), lo=P.min_("v"), hi=P.max_("v"), m=P.avg("v"), c=P.group_concat("s")).df.first()
    assert (out.t.value, out.t.datatype, out.lo.value, out.hi.value, out.m.value, out.c.value) == (
        "12", XSD_INTEGER, "2", "10", "6", "s1 s2")
    assert (out.m.datatype, out.c.datatype) == (P.XSD_DECIMAL, P.XSD_STRING)
    assert nums.group_by(t=P.sum_("v")).df.first().t is None  # one value that is no number
    cases = [  # values, sum, mean
        ([("9007199254740993", XSD_INTEGER), ("1", XSD_INTEGER)], ("9007199254740994", XSD_INTEGER),
         ("4503599627370497", P.XSD_DECIMAL)),
        ([("0.10", P.XSD_DECIMAL), ("2", XSD_INTEGER)], ("2.1", P.XSD_DECIMAL), ("1.05", P.XSD_DECIMAL)),
        ([("0.5", P.XSD_DOUBLE), ("1", XSD_INTEGER)], ("1.5", P.XSD_DOUBLE), ("0.75", P.XSD_DOUBLE)),
        ([(None, None)], ("0", XSD_INTEGER), ("0", XSD_INTEGER)),
    ]
    for values, total, mean in cases:
        rows = [(text(v, kind) if v else None,) for v, kind in values]
        got = P.inline_values(spark, ["v"], rows).group_by(t=P.sum_("v"), m=P.avg("v")).df.first()
        assert (got.t.value, got.t.datatype) == total and (got.m.value, got.m.datatype) == mean
    same = g.match("?s", "same", "?o")
    over = P.number("v") > 5  # a variable of the left side
    assert rows_of(ints.optional(same, over), "svo") == [("s1", "2", "-"), ("s2", "10", "s1")]
    assert rows_of(ints.exists(same, over), "s") == [("s2",)]
    assert rows_of(ints.not_exists(same, over), "s") == [("s1",)]
    with pytest.raises(ValueError):
        P.regex("v", "a", "q")
    ordered = [r.v.value for r in nums.order_by(P.order_key("v")).df.collect()]
    assert ordered == ["2", "10", "x"]
    for skip in range(5):
        rest = nums.order_by(P.order_key("v").desc()).slice(skip).df.collect()
        assert [r.v.value for r in rest] == ["x", "10", "2"][skip:]
    joined = nums.values(["s", "v"], [("s1", None), (None, text("x"))])
    assert rows_of(joined, "sv") == [("s1", "2"), ("s3", "x")]
    body = json.loads(sinks.results_json(nums.slice(0, 1).bind("u", F.lit(None).cast(P.TERM)), 5))
    one = body["results"]["bindings"][0]
    assert body["head"]["vars"] == ["s", "v", "u"] and set(one) == {"s", "v"}
    assert one["s"]["type"] == "uri" and one["v"]["type"] == "literal"
    with pytest.raises(P.TooManyRows):
        sinks.results_json(nums, 2)
    assert json.loads(sinks.ask_json(True)) == {"head": {}, "boolean": True}


def test_quads_on_disk(spark, quads, tmp_path):
    path = str(tmp_path / "quads")
    Q.write_quads(quads, path, buckets=4)
    assert canonical(Q.read_quads(spark, path).drop("graph_bucket")) == canonical(quads)
    one = Q.read_graph(spark, path, "b", buckets=4)
    assert {r.graph for r in one.collect()} == {NS.nodes + "b"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(graph_bucket" in plan

