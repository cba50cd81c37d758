"""Importance resampling towards a target distribution, over hashed word n-grams.

A feature is a run of one to three words; its bucket is the CRC-32 of its bytes
modulo the number of buckets. CRC-32 is linear over XOR: a byte's share depends on
its value and its distance from the end alone, and the length adds a constant. So
all features of many texts are hashed at once: shares are looked up in a table by
distance and byte and folded by `bitwise_xor.reduceat` over the features' spans.
Spans longer than the table fold block by block, the value so far being shifted
by a block's zero bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.frames import raw, slices, spread, table, texts
from catalogspark.llm.shingles import MARKS
from catalogspark.llm.spans import FOLD, gather, word_spans
from catalogspark.session import cut

#: Distances from the end that the table covers; longer spans fold by blocks.
REACH = 256
#: Bytes of features that are hashed together.
TOGETHER = 1 << 20
ONES = 0xFFFFFFFF


class PositionTable:
    """`crc32(data, starts, ends)`: the CRC-32 of each span, none empty."""

    def __init__(self, reach: int = REACH):
        self.reach = reach
        self.zeros = np.array([zlib.crc32(bytes(n)) for n in range(reach + 1)], np.uint32)
        one = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ self.zeros[1]
        share = np.empty((reach, 256), np.uint32)
        share[0] = one
        for distance in range(1, reach):
            share[distance] = self._behind(one, share[distance - 1])
        self.share = share.ravel()
        # a value followed by `reach` zero bytes, a table for each of its bytes
        self.shifts = []
        for place in range(4):
            now = (np.arange(256, dtype=np.uint32) << np.uint32(8 * place)).astype(np.uint32)
            for _ in range(reach):
                now = self._behind(one, now)
            self.shifts.append(now)

    @staticmethod
    def _behind(one: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The values after one more zero byte."""
        return one[value & np.uint32(255)] ^ (value >> np.uint32(8))

    def _fold(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """XOR of the shares of each span's bytes; lengths from 1 to `reach`."""
        flat, at = gather(data, starts, lengths)
        distance = np.repeat(at + lengths - 1, lengths) - np.arange(len(flat))
        return np.bitwise_xor.reduceat(self.share[distance << 8 | flat], at)

    def _long(self, data: np.ndarray, start: int, end: int) -> int:
        head = (end - start) % self.reach
        value = ONES
        if head:
            value ^= int(self.zeros[head]) ^ int(self._fold(data, np.array([start]), np.array([head]))[0])
        for at in range(start + head, end, self.reach):
            shifted = 0
            for place, by in enumerate(self.shifts):
                shifted ^= int(by[value >> 8 * place & 255])
            value = shifted ^ int(self._fold(data, np.array([at]), np.array([self.reach]))[0])
        return value ^ ONES

    def crc32(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = ends - starts
        out = np.empty(len(starts), np.uint32)
        short = lengths <= self.reach
        for i in np.flatnonzero(~short).tolist():
            out[i] = self._long(data, int(starts[i]), int(ends[i]))
        which = np.flatnonzero(short)
        total = np.cumsum(lengths[which])
        low = 0
        while low < len(which):
            base = int(total[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(total, base + TOGETHER, "right")))
            part = which[low:high]
            out[part] = self._fold(data, starts[part], lengths[part]) ^ self.zeros[lengths[part]]
            low = high
        return out


_TABLES: list[PositionTable] = []


def position_table() -> PositionTable:
    if not _TABLES:
        _TABLES.append(PositionTable())
    return _TABLES[0]


def _features(array: pa.Array, orders: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1 to `orders` words: (bucket of each run in order, first run of
    each value, number of words of each value)."""
    data, at = raw(array)
    data = FOLD[data]
    starts, ends, first = word_spans(data, at, MARKS)
    # the words with one space behind each, so that a run of words is one span
    flat, places = gather(np.append(data, np.uint8(32)), starts, ends - starts + 1)
    stops = places + (ends - starts)
    flat[stops] = 32
    words = np.diff(first)
    hashed = position_table()
    for size in range(1, orders + 1):
        counts = np.maximum(words - size + 1, 0)
        begin = np.concatenate([[0], np.cumsum(counts)])
        runs = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
        crc = hashed.crc32(flat, places[runs], stops[runs + size - 1])
        yield (crc % np.uint32(buckets)).astype(np.int64), begin, words


def _count(orders: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 0):
            for bucket, _, _ in _features(batch.column(0), orders, buckets):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def _weigh(gains: np.ndarray, orders: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            weight = np.zeros(batch.num_rows, np.int64)
            number = np.zeros(batch.num_rows, np.int64)
            words = number
            for bucket, begin, words in _features(batch.column(1), orders, len(gains)):
                running = np.concatenate([[0], np.cumsum(gains[bucket])])
                weight += running[begin[1:]] - running[begin[:-1]]
                number += np.diff(begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number), pa.array(words.astype(np.int64)), pa.array(weight)],
                ["doc_id", "n_features", "n_words", "weight"],
            )

    return run


def bucket_counts(docs: DataFrame, orders: int = 3, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket; a task adds up its own before they are
    summed, and `buckets` numbers reach the driver."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    parts = text.mapInArrow(_count(orders, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket."""
    n = float(len(source))
    ratio = (target + 1.0) * (float(source.sum()) + n) / ((source + 1.0) * (float(target.sum()) + n))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def importance(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, orders: int = 3, seed: int = 42,
    percent: int = 5, least_words: int = 20,
) -> DataFrame:
    """-> (doc_id, n_features, n_words, weight, score, rank), a row for each row of
    `docs`.

    `weight` is the sum of the gains of a text's features, `score` that with a
    Gumbel number drawn from the seed and the doc_id. Of the rows with at least
    `least_words` words, floor(percent * rows / 100) of the highest scores are
    drawn without replacement and ranked from 1, ties to the smaller doc_id, null
    ids last; the others' rank is null. A null or empty text has no features and
    weight 0. Rows that repeat a doc_id share its Gumbel number and are drawn each
    for itself. Without a target all features are equally likely there; no rows:
    no rows. Other columns are ignored.

    Texts are read twice and never shuffled. Ranks come from a range sort of the
    scores and the sizes of the ranges before.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = cut(
        texts(docs)
        .mapInArrow(_weigh(gain, orders), "doc_id long, n_features long, n_words long, weight long")
        .withColumn("score", F.col("weight") + gumbel)
        .withColumn("row", F.monotonically_increasing_id())
    )
    order = [F.col("n_words") < least_words, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = cut(
        scored.repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    # the place counts within its range from the range's number times 2^33
    part = F.shiftright("place", 33)
    ranges = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("n_words") >= least_words).alias("long"))
    sizes = ranges.orderBy("part").collect()  # one row for each range
    draws = percent * sum(r.long for r in sizes) // 100
    before, bases = 0, []
    for r in sizes:
        bases.append((r.part, before))
        before += r.n
    base = F.broadcast(spark.createDataFrame(bases, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(base, "part").select(
        "doc_id", "n_features", "n_words", "weight", "score", F.when(rank <= draws, rank).alias("rank")
    )


def resample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` whose doc_id is drawn, with all their columns."""
    drawn = importance(docs, target, **parameters).filter(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.alias("d").join(drawn.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left_semi")


def op12_position_crc(spark, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )
