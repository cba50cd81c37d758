"""Connected components by alternating star contractions.

Each round points every node's larger neighbours (large star) and then its
smaller ones (small star) at the smallest it knows, until nothing changes: all
edges then lead from a node to its component's smallest one. Rounds grow with
the logarithm of the longest path. Edges stay in tables of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b), in any direction, repeated or with a = b -> (node, comp)
    for every node that has an edge to another; comp is its component's
    smallest node. No edges: no rows. Nodes must not be null."""
    now = cut(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        now = cut(small.distinct())
        before, state = state, _state(now)
        if state == before:
            break
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        tops.select("node", F.col("node").alias("comp"))
    )
