"""Skipping rows of an order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.session import cut


def behind(df: DataFrame, offset: int, *order: Column | str) -> DataFrame:
    """The rows behind the first `offset` ones, in order. Ranges of the order are
    counted, whole ones skipped, and only the range the offset falls into is
    numbered."""
    ranges = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in ranges.groupBy("_range").count().collect())
    for number, size in sizes:
        if offset < size:
            break
        offset -= size
    else:
        return df.limit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    edge = ranges.filter(F.col("_range") == number).withColumn("_place", place)
    rest = ranges.filter(F.col("_range") > number)
    kept = edge.filter(F.col("_place") > offset).drop("_place").unionByName(rest)
    return kept.drop("_range").orderBy(*order)
