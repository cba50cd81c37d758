"""What keeps large tables off the driver and the executors' disks."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from catalogspark.functions import iri
from catalogspark.operators import views, visibility
from catalogspark.operators.bgp import characteristic_sets
from catalogspark.operators.pattern import Graph
from catalogspark.schema import DCAT, NS, QUADS, RDF_TYPE, XSD_STRING, Namespace
from catalogspark.session import CLEANUP, checkpoint_root, cut
from catalogspark.sources import quads as Q

BASE = NS.nodes + "n"


def _quads(spark, *rows):
    return spark.createDataFrame([(BASE, s, p, o, kind, "" if kind == "iri" else XSD_STRING, "") for s, p, o, kind in rows], QUADS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (blocks.apply(i).getName() for i in range(blocks.size())) if name.startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    out = cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP, None) == setting
    assert out.count() == 7


def _codecs(path):
    found = glob.glob(f"{path.removeprefix('file:')}/**/*.parquet", recursive=True)
    metas = [pq.ParquetFile(f).metadata for f in found]
    return {m.row_group(0).column(0).compression for m in metas if m.num_row_groups}


def test_quads_are_stored_compressed(spark):
    quads = _quads(spark, ("urn:a", RDF_TYPE, "urn:b", "iri"), ("urn:a", DCAT + "x", "t", "literal"))
    path = f"{checkpoint_root(spark)}/compressed"
    Q.write_quads(quads, f"{path}/quads")
    Q.write_clustered(quads, "compressed_quads", f"{path}/clustered", buckets=2)
    assert _codecs(f"{path}/quads") == _codecs(f"{path}/clustered") == {"ZSTD"}
    assert _codecs(cut(quads, "zstd").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) == {"ZSTD"}
    spark.sql("DROP TABLE compressed_quads")


def _owned(spark):
    return _quads(
        spark,
        (f"{BASE}/datasets/a", "urn:p", "1", "literal"),
        (f"{BASE}/datasets/b", "urn:p", "2", "literal"),
        (f"{BASE}/datasets/a/distributions/0", DCAT + "accessService", f"{BASE}/services/s", "iri"),
        (f"{BASE}/datasets/a/distributions/1", DCAT + "accessService", f"{BASE}/services/t", "iri"),
        (f"{BASE}/catalogs/c", DCAT + "dataset", f"{BASE}/datasets/a", "iri"),
        (f"{BASE}/catalogs/c", DCAT + "dataset", f"{BASE}/datasets/b", "iri"),
        (f"{BASE}/catalogs/c", "urn:p", "3", "literal"),
        ("urn:other", "urn:p", "urn:else", "iri"),
    )


def test_owners_are_looked_up_without_a_broadcast(spark):
    quads = _owned(spark)
    allowed = cut(spark.createDataFrame([(f"{BASE}/datasets/a",), (f"{BASE}/services/s",), (None,)], "iri string"))
    shown = visibility.visible_quads(quads, allowed)
    assert "BroadcastHashJoin" not in _plan(shown)
    want = {
        (f"{BASE}/datasets/a", "1"), (f"{BASE}/datasets/a/distributions/0", f"{BASE}/services/s"),
        (f"{BASE}/catalogs/c", f"{BASE}/datasets/a"), (f"{BASE}/catalogs/c", "3"), ("urn:other", "urn:else"),
    }
    assert sorted((r.s, r.o) for r in shown.collect()) == sorted(want)
    masks = views.Masks(None, None, cut(spark.createDataFrame([(f"{BASE}/datasets/a", "m"), (f"{BASE}/services/s", "k")], "iri string, mask string")))
    viewed = views.view_quads(quads, masks)
    assert "BroadcastHashJoin" not in _plan(viewed)
    assert {(r.s, r.o): r.view for r in viewed.collect()} == dict(zip(sorted(want), ["", "m", "m", "k&m", ""], strict=True))


def test_owner_is_found_without_splitting(spark):
    for ns in (NS, Namespace(nodes="urn:node:"), Namespace(nodes="http://a/b")):
        n = ns.nodes
        want = {
            None: None, "": None, n: None, n + "a": None, n + "a/": n + "a/", n + "a/catalogs": None, n + "catalogs": None,
            n + "datasets": None, n + "a/catalogs/c/d": None, n + "a/datasets": n + "a/datasets", n + "a/datasets/": n + "a/datasets/",
            n + "a/datasets/d": n + "a/datasets/d", n + "a/datasets/d/policies/0": n + "a/datasets/d",
            n + "a/services/s/x": n + "a/services/s", n + "a/xdatasets/d": n + "a/xdatasets/d", n + "a/b/datasets/d": n + "a/b/datasets/d",
            "urn:else/datasets/d/e": None,
        }
        df = spark.createDataFrame([(k,) for k in want], "i string").select("i", iri.owning_resource(F.col("i"), ns).alias("own"))
        assert "split" not in _plan(df)
        assert {r.i: r.own for r in df.collect()} == want


def test_predicates_get_their_folder_without_a_pattern(spark):
    cases = {RDF_TYPE: "type", DCAT + "dataset": "dataset", DCAT: "other", "urn:x#dataset": "other", DCAT + "a/b": "b", None: "other"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", Q._predicate_part(F.col("p")).alias("part"))
    assert "regexp" not in _plan(df)
    assert {r.p: r.part for r in df.collect()} == cases


def test_characteristic_sets_deal_subjects_once(spark):
    sets = characteristic_sets(_quads(spark, ("urn:a", "urn:p", "1", "literal"), ("urn:a", "urn:p", "2", "literal"), ("urn:a", "urn:q", "1", "literal"), ("urn:b", "urn:p", "1", "literal")))
    assert _plan(sets).count("Exchange hashpartitioning") == 2
    assert {(*r.predicates, r.n_subjects, r.n_quads) for r in sets.collect()} == {("urn:p", "urn:q", 1, 3), ("urn:p", 1, 1)}


def test_stars_are_not_broadcast(spark):
    rows = [(f"urn:{i}", p, f"urn:{i % 3}", "iri") for i in range(9) for p in ("urn:p", "urn:q")]
    found = Graph(cut(_quads(spark, *rows))).patterns(("?a", "urn:p", "?b"), ("?a", "urn:q", "?c"), ("?b", "urn:p", "?d"))
    assert "Broadcast" not in _plan(found.df)
    assert found.df.count() == 9
