from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import reach as R


def closure(edges, nodes=()):
    """Plain pairs by at least one step, and all nodes."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    names = {n for e in edges for n in e} | set(nodes)
    pairs = set()
    for a in names:
        todo, seen = list(out.get(a, ())), set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo.extend(out.get(b, ()))
        pairs |= {(a, b) for b in seen}
    return pairs, names


def check(spark, edges, nodes=()):
    df = spark.createDataFrame([*edges, ("x0", None), (None, "x1")], "a string, b string")
    found = R.reach(df, spark.createDataFrame([(n,) for n in [*nodes, None]], "node string"))
    pairs, names = closure(edges, nodes)
    want = {True: pairs | {(n, n) for n in names}, False: pairs}
    for zero in (True, False):
        got = [tuple(r) for r in found.pairs(zero).collect()]
        assert len(got) == len(set(got)) and set(got) == want[zero]
        sums = {r.node: r.n for r in found.counts(zero).collect()}
        assert sums == {n: sum(a == n for a, _ in want[zero]) for n in names}
    least = {r.node: r.least for r in found.least_members().collect()}
    assert least == {n: min([n, *(m for m in names if (n, m) in pairs and (m, n) in pairs)]) for n in names}
    spans = [(r.component, r.low, r.high) for r in found.spans.collect()]
    for c, low, high in spans:
        assert not any(c == d and max(low, lo) <= min(high, hi) and (low, high) != (lo, hi) for d, lo, hi in spans)
    return found, want


def random_edges(seed, n, m, forward):
    r = random.Random(seed)
    out = set()
    for _ in range(m):
        a, b = r.randrange(n), r.randrange(n)
        if forward and a >= b:
            continue
        out.add((f"n{a:02d}", f"n{b:02d}"))
    return sorted(out)


@pytest.mark.parametrize("edges", [
    [], [("a", "a")], [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "d"), ("e", "f"), ("a", "f")],
    [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)] + [("c05", "c02"), ("z", "c09")],
    random_edges(1, 25, 45, True), random_edges(2, 30, 40, False),
], ids=["none", "loop", "cycles", "chain", "acyclic", "cyclic"])
def test_labels(spark, edges):
    check(spark, edges, ["alone"])


def test_shared_descendants_stay_spans(spark):
    """A thousand nodes over a common tail: spans by nodes, not by pairs."""
    edges = [("root", f"d{i:03d}") for i in range(200)] + [(f"d{i:03d}", "hub") for i in range(200)]
    edges += [("hub", f"t{i:03d}") for i in range(200)]
    found, want = check(spark, edges)
    assert len(want[False]) > 40_000 and found.spans.count() < 3 * 402
    some = spark.createDataFrame([("d007", "t150"), ("t150", "d007"), ("root", "root"), ("nobody", "hub")], "a string, b string")
    assert {tuple(r) for r in found.reaches(some).collect()} == {("d007", "t150"), ("root", "root")}
    assert {tuple(r) for r in found.reaches(some, zero=False).collect()} == {("d007", "t150")}
    starts = spark.createDataFrame([("d001",), ("nobody",)], "node string")
    assert found.pairs(starts=starts).count() == 202


def test_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    rows = sorted((r.k, r.v, r.before) for r in R.running(df, "v", "k").collect())
    total = 0
    for _, v, before in rows:
        assert before == total
        total += v


def test_nodes_that_share_a_hash(spark, monkeypatch):
    """Ids are hashes; where two nodes have the same one, all are numbered."""
    monkeypatch.setattr(R, "_hash", lambda node: F.pmod(F.xxhash64(node), F.lit(7)))
    check(spark, random_edges(2, 30, 40, False), ["alone"])
    check(spark, random_edges(1, 25, 45, True), ["alone"])


def test_labels_join_no_nodes_by_text(spark, monkeypatch):
    """Nodes get short ids where they are read; none is looked up or broadcast."""
    seen = []
    cut = R.cut
    monkeypatch.setattr(R, "cut", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.createDataFrame(random_edges(1, 25, 45, True), "a string, b string")
    sums = R.reach(edges).counts(zero=False)
    assert not any("Join" in plan and "node#" in plan for plan in seen)
    assert not any("BroadcastExchange" in plan and "_base" not in plan for plan in seen)
    want = {n: sum(a == n for a, _ in pairs) for pairs, names in [closure(random_edges(1, 25, 45, True))] for n in names}
    assert {r.node: r.n for r in sums.collect()} == want
