"""Helpers of this subpackage around DataFrames and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.session import checkpoint_root

#: Bytes of text that a task holds at a time; a longer text stands alone.
SLICE_BYTES = 1 << 20


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder the session names."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def whole(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name meets those of an operator."""
    return F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns])


def spread(spark: SparkSession) -> int:
    """Partitions for data dealt anew: as many as the session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most `size` bytes of the text in `column`."""
    for batch in batches:
        ends = offsets(batch.column(column))[1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else offsets(batch.column(column))[0]
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _width(array: pa.Array):
    return np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32


def offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of the values of a text column, one more than values."""
    whole = np.frombuffer(array.buffers()[1], _width(array)) if array.buffers()[1] else np.zeros(1, np.int64)
    return whole[array.offset : array.offset + len(array) + 1].astype(np.int64)


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its values in them;
    null has no bytes."""
    at = offsets(array)
    data = array.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
