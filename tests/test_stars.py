"""Basic graph patterns by stars, the clustered layout, and joins by masks."""

from __future__ import annotations

import itertools
import random

import pytest

from catalogspark.operators import pattern as P
from catalogspark.operators.bgp import characteristic_sets
from catalogspark.operators.pattern import Graph, Solutions, text
from catalogspark.schema import DCAT, DCT, QUADS, RDF_TYPE
from catalogspark.session import cut
from catalogspark.sources import quads as Q

PREDICATES = [DCAT + "distribution", DCT + "format", "urn:p", "urn:q"]


def facts(seed):
    r = random.Random(seed)
    names = [f"urn:n{i}" for i in range(9)]
    out = set()
    for _ in range(60):
        iri = r.random() < 0.7
        out.add((r.choice(names), r.choice(PREDICATES), r.choice(names) if iri else r.choice(["x", "urn:n1"]), "iri" if iri else "literal"))
    out |= {(n, RDF_TYPE, "urn:T", "iri") for n in names[:5]}
    return sorted(out)


def plain(rows, triples):
    """All bindings, by trying every quad for every triple."""
    found = [{}]
    for s, p, o in triples:
        step = []
        for binding in found:
            for row in rows:
                own = dict(binding)
                for term, value in ((s, (row[0], "iri")), (p, (row[1], "iri")), (o, (row[2], row[3]))):
                    if isinstance(term, P.Literal):
                        term = (term.value, "literal")
                    elif not term.startswith("?"):
                        term = (term, "iri")
                    if isinstance(term, tuple):
                        if term != value:
                            break
                    elif own.setdefault(term[1:], value) != value:
                        break
                else:
                    step.append(own)
        found = step
    return sorted(tuple(sorted(b.items())) for b in found)


def shown(solutions):
    return sorted(tuple(sorted((v, (r[v].value, r[v].kind)) for v in solutions.vars)) for r in solutions.df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = facts(4)
    types = {"iri": "", "literal": "http://www.w3.org/2001/XMLSchema#string"}
    quads = spark.createDataFrame([("urn:g", s, p, o, k, types[k], "") for s, p, o, k in rows], QUADS)
    path = f"{tmp_path_factory.mktemp('store')}/clustered"
    Q.write_clustered(quads, "clustered_test", path, buckets=8)
    return rows, cut(quads), Q.read_clustered(spark, "clustered_test"), path


PATTERNS = [
    [("?a", RDF_TYPE, "urn:T"), ("?a", DCAT + "distribution", "?b"), ("?b", DCT + "format", "?f")],
    [("?a", "urn:p", "?b"), ("?a", "urn:q", "?b"), ("?b", "urn:p", "?c")],
    [("?a", "urn:p", "?a"), ("?a", "urn:q", "?x")],
    [("?a", "urn:p", "?x"), ("?b", "urn:q", "?x"), ("?b", RDF_TYPE, "urn:T")],
    [("?a", "?p", "?b"), ("?b", DCT + "format", text("x"))],
    [("urn:n1", "urn:p", "?b"), ("?b", "?q", "?c")],
    [("?a", "urn:p", "?b"), ("?b", "urn:p", "?a"), ("?a", "urn:q", "?c")],
    [("?s", "urn:p", "?o"), ("?o", "urn:p", "?p"), ("?s", "urn:q", "?graph")],
]


@pytest.mark.parametrize("triples", PATTERNS, ids=range(len(PATTERNS)))
def test_any_order_gives_the_same_rows(stored, triples):
    rows, quads, clustered, _ = stored
    want = plain(rows, triples)
    orders = list(itertools.permutations(triples))
    graphs = [Graph(quads), Graph(clustered, sets=cut(characteristic_sets(quads)))]
    for graph, order in zip(itertools.cycle(graphs), orders[:4] + orders[-2:]):
        assert shown(graph.patterns(*order)) == want


def test_unlinked_patterns_are_refused(stored):
    with pytest.raises(P.UnboundedProduct):
        Graph(stored[1]).patterns(("?a", "urn:p", "?b"), ("?c", "urn:q", "?d"))


def test_no_shuffle_within_a_star(spark, stored):
    rows, _, clustered, path = stored
    for size in ("-1", str(10 << 20)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        try:
            found = Graph(clustered).patterns(("?a", RDF_TYPE, "urn:T"), ("?a", "urn:p", "?b"), ("?a", DCT + "format", "?c"))
            plan = found.df._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        if size == "-1":
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "PartitionFilters: [isnotnull(p_part" in plan.replace("\n", " ")
    # another session names the table anew
    Q.register_clustered(spark, "clustered_again", path, buckets=8)
    again = Q.read_clustered(spark, "clustered_again")
    assert shown(Graph(again).patterns(*PATTERNS[0])) == plain(rows, PATTERNS[0])
    spark.sql("DROP TABLE clustered_again")


def test_characteristic_sets(stored):
    rows, quads, _, _ = stored
    want = {}
    for s in {r[0] for r in rows}:
        own = [r[1] for r in rows if r[0] == s]
        n, m = want.get(tuple(sorted(set(own))), (0, 0))
        want[tuple(sorted(set(own)))] = (n + 1, m + len(own))
    assert {tuple(r.predicates): (r.n_subjects, r.n_quads) for r in characteristic_sets(quads).collect()} == want


def test_four_loose_variables(spark, monkeypatch):
    r = random.Random(8)
    schema = ", ".join(f"{v} {P.TERM}" for v in "abcd")
    masks = [(1, 1, 1, 1), (1, 0, 1, 0), (0, 0, 0, 1)]

    def side(names, masks):
        rows = []
        for _ in range(25):
            mask = r.choice(masks)
            rows.append(tuple((r.choice("12"), "iri", "", "") if m else None for m in mask))
        return rows, Solutions(spark.createDataFrame(rows, schema).toDF(*names), frozenset(names))

    left, ls = side("abcd", masks)
    right, rs = side("abcd", masks[:2])
    joins = []
    real = type(ls.df).join
    monkeypatch.setattr(type(ls.df), "join", lambda self, *a, **k: (joins.append(1), real(self, *a, **k))[1])
    joined = ls.join(rs)
    assert len(joins) <= 6  # pairs of masks that occur
    monkeypatch.undo()
    fits = lambda x, y: all(a is None or b is None or a == b for a, b in zip(x, y))
    show = lambda rows: sorted(repr(tuple(t and t[0] for t in row)) for row in rows)
    both = [tuple(a or b for a, b in zip(x, y)) for x in left for y in right if fits(x, y)]
    assert show(map(tuple, joined.df.select(*"abcd").collect())) == show(both)
    alone = [x for x in left if not any(fits(x, y) for y in right)]
    assert show(map(tuple, ls.optional(rs).df.select(*"abcd").collect())) == show(both + alone)
    meets = lambda x, y: fits(x, y) and any(a and b for a, b in zip(x, y))
    assert show(map(tuple, ls.minus(rs).df.collect())) == show(x for x in left if not any(meets(x, y) for y in right))
    none = Solutions(rs.df.limit(0), rs.maybe)
    assert ls.join(none).df.count() == 0 and ls.optional(none).df.count() == len(left)
