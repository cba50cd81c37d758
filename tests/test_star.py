"""The driver tables as catalogs: what grows with them stays off the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import encode, offers, pattern, policy, visibility
from catalogspark.sources import responses, star
from tests.build import canonical

SF = "/root/testdata/sf0.001"


def _broadcast(df) -> bool:
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_not_broadcast(spark):
    """Small as a file, the part table is long as rows of rules and constraints."""
    for variant in ("", "groups"):
        tables = star.tables(spark, SF, variant)
        for name in ("datasets", "policies", "rules", "constraints"):
            assert not _broadcast(getattr(tables, name)), name


def test_policy_sets_are_not_broadcast(spark, monkeypatch):
    """Keys of policy sets are as many as datasets."""
    seen = []
    monkeypatch.setattr(policy, "cut", lambda df: seen.append(df) or df)
    policy.policy_sets(star.tables(spark, SF))
    assert not _broadcast(seen[0])


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_rendered_once(spark):
    """Checks that read a body several times don't build it several times, and the
    newest responses come from one reading."""
    checked = responses.check_responses(star.responses(spark, SF))
    plan = _plan(responses.latest_good(checked))
    assert plan.count("StructsToJsonEvaluator") == 1
    assert plan.count("parseJson") == 1
    assert plan.count("Relation [") == 2  # line items and parts


def _broadcasts(df) -> list[str]:
    """The plans below broadcasts, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


def test_encoding_broadcasts_catalogs_alone(spark):
    """Datasets, services and groups grow with the tables; one IRI a catalog doesn't."""
    for variant in ("", "groups"):
        below = _broadcasts(encode.encode(star.tables(spark, SF, variant)))
        assert below
        for plan in below:
            assert not any(c in plan for c in ("p_partkey", "s_suppkey", "l_suppkey")), plan


def test_offers_and_views_do_not_broadcast_datasets(spark):
    """What is kept of datasets and services, and what is joined to each dataset."""
    tables = star.tables(spark, SF)
    visible = tables.datasets.filter("idx % 2 = 0")
    shown = visibility.filter_catalogs(tables, visible)
    for df in (shown.datasets, shown.distributions, shown.services, shown.constraints, offers.dataset_offers(tables)):
        assert not _broadcasts(df)
    sets = visibility.service_sets(tables, visible.withColumn("policy_set", F.lit("x")))
    assert not _broadcasts(sets)


def test_long_solutions_are_not_broadcast(spark, monkeypatch):
    """Solutions joined by masks are counted, and hinted when they are many."""
    value = lambda n: pattern.literal_term((F.col("id") % n).cast("string"))
    rows = spark.range(60).select(value(20).alias("x"), F.when(F.col("id") % 3 > 0, value(7)).alias("a"))
    side = pattern.Solutions(rows, frozenset({"a"}))
    short = side.join(side).df
    monkeypatch.setattr(pattern, "LONG", 10)
    long = side.join(side).df
    assert _broadcasts(short) and not _broadcasts(long)
    assert canonical(short) == canonical(long)


def test_callers_are_not_broadcast(spark, monkeypatch):
    """Every customer may be a class of its own; their groups are few."""
    seen = []
    cut = policy.cut
    monkeypatch.setattr(policy, "cut", lambda df: seen.append(df) or cut(df))
    rows = star.read(spark, SF, "customer")
    classes = rows.selectExpr("c_name AS class_key", "map('segment', array(c_mktsegment)) AS claims")
    found = policy.entitle(star.tables(spark, SF), classes).count_by_class()
    for df in [found, *(df for df in seen if "class_key" in df.columns)]:
        assert not any("class_key" in plan for plan in _broadcasts(df))
