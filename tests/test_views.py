"""Views of several classes at once, and differences by digests."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import digests, encode, views, visibility
from catalogspark.operators.policy import entitle
from catalogspark.schema import QUADS
from catalogspark.session import cut
from catalogspark.sources import quads as quads_table
from tests.build import Builder, canonical, permit

CLAIMS = {"a1": "a", "a2": "a", "b": "b", "c": "c", "none": None}


@pytest.fixture(scope="module")
def tables(spark):
    b = Builder(spark)
    for node in ("n1", "n2"):
        b.catalog(node, owner=node)
        for service in ("open", "shared", "only-a", "idle"):
            b.service(node, service)
        b.dataset(node, "free", [("csv", "open"), ("csv", "ghost")])
        b.dataset(node, "for-a", [("csv", "shared"), ("csv", "only-a")], [permit(("group", "eq", "a"))])
        b.dataset(node, "for-b", [("csv", "shared")], [permit(("group", "eq", "b"))])
        b.dataset(node, "for-nobody", [("csv", "open")], [permit(("group", "eq", "x"), ("group", "neq", "x"))])
    return b.tables()


def classes(spark, claims):
    rows = [(k, {"group": [v]} if v else {}) for k, v in claims.items()]
    return spark.createDataFrame(rows, "class_key string, claims map<string, array<string>>")


def test_each_class_sees_what_it_would_see_alone(spark, tables):
    quads = cut(encode.encode(tables))
    entitled = entitle(tables, classes(spark, CLAIMS))
    masks = views.class_masks(tables, entitled)
    viewed = cut(views.view_quads(quads, masks))
    shown = cut(views.view_classes(viewed.select("view"), masks))
    allowed = cut(visibility.allow_list(tables, entitled))
    sizes = {r.class_key: r.n for r in views.count_by_class(viewed, masks).collect()}
    for key in CLAIMS:
        alone = cut(visibility.visible_quads(quads, allowed.filter(F.col("class_key") == key)))
        mine = views.quads_of(viewed, shown, F.lit(key))
        assert canonical(mine) == canonical(alone)
        assert sizes[key] == alone.count()
    assert sizes["a1"] == sizes["a2"] and len({sizes[k] for k in ("a1", "none")}) == 2
    # classes of one group share a number
    assert masks.callers.select("caller_no").distinct().count() == 4


def test_masks_of_many_callers(spark, tables):
    """Numbers beyond one bitmap's 32,768 callers."""
    callers = spark.range(70_000).select(
        F.concat(F.lit("k"), "id").alias("class_key"),
        F.expr("map('group', array(if(id % 7 = 0, 'a', 'g' || id)))").alias("claims"),
    )
    wanted = Builder(spark)
    wanted.catalog("n")
    wanted.dataset("n", "mine", [], [permit(("group", "eq", "a"))])
    wanted.dataset("n", "free")
    held = wanted.tables()
    masks = views.class_masks(held, entitle(held, callers))
    counts = cut(views.count_by_class(views.view_quads(cut(encode.encode(held)), masks), masks))
    mine = counts.groupBy((F.substr("class_key", F.lit(2)).cast("int") % 7 == 0).alias("a")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("k")
    )
    got = {r.a: (r.low, r.high, r.k) for r in mine.collect()}
    assert got[True][0] == got[True][1] > got[False][0] == got[False][1]
    assert got[True][2] == 10_000 and got[False][2] == 60_000


def test_views_of_nothing(spark, tables):
    none = tables.map(lambda _, df: df.limit(0))
    masks = views.class_masks(none, entitle(none, classes(spark, CLAIMS)))
    viewed = views.view_quads(spark.createDataFrame([], QUADS), masks)
    assert viewed.isEmpty() and views.count_by_class(viewed, masks).isEmpty()


def test_store_diff_reads_only_what_differs(spark, tables, tmp_path):
    now = cut(encode.encode(tables))
    graph = f"{now.select(F.min('graph')).first()[0]}"
    gone = (F.col("graph") == graph) & F.col("o").contains("for-b")
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    digests.write_store(now, old)
    digests.write_store(now.filter(~gone), new)
    assert canonical(digests.diff_stores(spark, old, new)) == canonical(
        now.filter(gone).withColumn("change", F.lit("removed"))
    )
    wanted, folders = digests.differing_leaves(spark, old, new)
    assert [r.graph for r in wanted.select("graph").distinct().collect()] == [graph] and len(folders) == 1
    plan = digests.diff_stores(spark, old, new)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"PartitionFilters: \[[^\]]*graph_bucket#\d+ = {folders[0]}\)", plan)) == 2, plan
    assert digests.diff_stores(spark, old, old).isEmpty()
    # a graph that one side lacks, and an empty side
    digests.write_store(now.filter(F.col("graph") != graph), new)
    assert canonical(digests.diff_stores(spark, new, old)) == canonical(
        now.filter(F.col("graph") == graph).withColumn("change", F.lit("added"))
    )
    digests.write_store(now.limit(0), new)
    assert digests.diff_stores(spark, old, new).count() == now.count()


def test_one_property_of_all_subjects_differs_in_few_leaves(spark, tmp_path):
    """Leaves are cut by predicate, and quads of a written layout aren't dealt again."""
    rows = [("g", f"s{i}", f"p{j}", str(i)) for i in range(300) for j in range(20)]
    quads = spark.createDataFrame(rows, "graph string, s string, p string, o string").selectExpr(
        "*", "'literal' AS o_kind", "'' AS o_datatype", "'' AS o_lang"
    )
    quads_table.write_quads(quads, f"{tmp_path}/now")
    now = quads_table.read_quads(spark, f"{tmp_path}/now")
    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    digests.write_store(now, old, clustered=True)
    digests.write_store(now.filter("p <> 'p7'"), new, clustered=True)
    found = digests.diff_stores(spark, old, new)
    assert canonical(found.select("s", "p", "change")) == canonical(
        quads.filter("p = 'p7'").selectExpr("s", "p", "'removed' AS change")
    )
    wanted, _ = digests.differing_leaves(spark, old, new)
    assert wanted.count() <= digests.LEAVES // digests.PREDICATES
    read = quads_table.read_quads(spark, f"{old}/quads").drop("graph_bucket")
    assert canonical(read) == canonical(quads)
