"""The quad table on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions import iri
from catalogspark.schema import DCAT, DCT, NS, ODRL, QUADS, RDF_TYPE, Namespace
from catalogspark.session import shuffles_dropped

#: Vocabularies whose predicates are few and have a folder each.
VOCABULARIES = (DCAT, DCT, ODRL, RDF_TYPE.rsplit("type", 1)[0])

BUCKETS = 64
#: IRIs repeat each other's beginnings.
COMPRESSION = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def graph_bucket(graph: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(graph), F.lit(buckets)).cast("int")


def write_quads(
    quads: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite", clustered: bool = False
) -> None:
    """Write partitioned by graph bucket; within a bucket rows are clustered by
    subject, so a very large graph spreads over many files. Quads read from this
    layout are `clustered` already and aren't shuffled for it again."""
    placed = quads.withColumn("graph_bucket", graph_bucket(F.col("graph"), buckets))
    if not clustered:
        placed = placed.repartition("graph_bucket", F.pmod(F.xxhash64("graph", "s"), F.lit(32)))
    with shuffles_dropped(quads.sparkSession):
        (
            placed.sortWithinPartitions("graph_bucket", "graph", "s")
            .write.mode(mode).options(**COMPRESSION)
            .partitionBy("graph_bucket")
            .parquet(path)
        )


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{QUADS}, graph_bucket INT").parquet(path)


def read_graph(
    spark: SparkSession, path: str, node_id: str, buckets: int = BUCKETS, ns: Namespace = NS
) -> DataFrame:
    """One node's quads: prunes to one bucket folder, then to row groups."""
    row = spark.range(1).select(
        iri.node_iri(F.lit(node_id), ns).alias("graph")
    ).select("graph", graph_bucket(F.col("graph"), buckets).alias("bucket")).first()
    return read_quads(spark, path).filter(
        (F.col("graph_bucket") == row.bucket) & (F.col("graph") == row.graph)
    )


# A second layout for patterns: by predicate, and by subject within.


def predicate_part(p: str) -> str:
    """Folder of a predicate: its own for predicates of the vocabularies in use, a
    common one for properties, of which there may be any number."""
    return (p.startswith(VOCABULARIES) and p.rsplit("/", 1)[-1].rsplit("#", 1)[-1]) or "other"


def _predicate_part(p: Column) -> Column:
    local = F.substring_index(F.substring_index(p, "/", -1), "#", -1)
    known = F.lit(False)
    for prefix in VOCABULARIES:
        known = known | F.startswith(p, F.lit(prefix))
    return F.when(known & (local != ""), local).otherwise("other")


def write_clustered(quads: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Save as a table of the session's catalog, its files in `path`: a folder for
    each predicate, and in it a file for each bucket of subjects, sorted. A pattern
    reads its predicate's folder, and patterns of one subject are joined bucket by
    bucket, without a shuffle. All quads of a subject lie in one bucket, so the
    layout suits subjects of bounded size; read the other one for lists that a
    whole catalog hangs on."""
    with shuffles_dropped(quads.sparkSession):
        (
            quads.withColumn("p_part", _predicate_part(F.col("p")))
            .repartition(buckets, "s")
            .write.mode("overwrite").format("parquet").option("path", path).options(**COMPRESSION)
            .partitionBy("p_part").bucketBy(buckets, "s").sortBy("s").saveAsTable(table)
        )


def register_clustered(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Name a clustered table that another session wrote."""
    spark.sql(
        f"CREATE TABLE {table} ({QUADS}, p_part STRING) USING parquet PARTITIONED BY (p_part) "
        f"CLUSTERED BY (s) SORTED BY (s) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {table}")


def read_clustered(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
