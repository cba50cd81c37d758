"""Exact top-k inner products through a pivot-distance index.

With R the largest norm, a vector v gets the component sqrt(R^2 - |v|^2) more and
a query gets 0, so that d(q, v)^2 = |q|^2 + R^2 - 2 q.v: the nearest vectors have
the largest products. Every vector is keyed by its nearest pivot and its distance
from it, in annuli of about equal numbers. By the triangle inequality an annulus
from lo to hi can hold no product over (|q|^2 + R^2 - LB^2) / 2, where LB is
max(0, d(q, p) - hi, lo - d(q, p)).

A query first visits its annuli in the order of that bound until they hold
enough vectors, which gives it a k-th best product; then it visits every other
annulus whose bound reaches that product, and no other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.llm.frames import table
from catalogspark.session import cut

#: Pivots (a bounded sample of the vectors), and annuli of each.
PIVOTS, RINGS = 16, 16
#: Vectors a query visits first.
FIRST = 1024
#: Vectors and queries of an annulus that meet in one task.
VECTORS, QUERIES = 2048, 512
#: Scores are longs; these stand for all beyond them, on either side.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Stands for a null vec_id, behind all others.
NO_ID = (1 << 63) - 1


def _matrix(values: Iterable[bytes], width: int) -> np.ndarray:
    """Vectors of up to `width` components, filled with zeros."""
    whole = np.zeros((len(values), width))
    for row, value in zip(whole, values):
        own = np.frombuffer(value, "<f8")
        row[: len(own)] = own
    return whole


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, norms = [], []
        for own in batch.column(1).to_pylist():
            own = np.floor(np.array(own, "<f8"))  # whole numbers of any size
            packed.append(own.tobytes())
            norms.append(float((own**2).sum()))
            if not np.isfinite(norms[-1]):
                raise OverflowError("the square of a vector's norm is beyond a double")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary()), pa.array(norms, pa.float64()),
             pa.array([len(p) // 8 for p in packed], pa.int32())],
            ["vec_id", "v", "norm2", "width"],
        )


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Integer inner products; by floats where these are exact. None where they
    may not fit a long."""
    most = float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] if x.size and y.size else 0
    largest = max(float(np.abs(z).max()) if z.size else 0 for z in (x, y))
    if most >= 2**62 or largest >= 2**62:
        return None
    if most < 2**53:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def _leading(q: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k vectors with the largest products of any size, in
    Python's integers for those that rounding leaves in question; ties in order."""
    near, take = vectors @ q, np.arange(len(vectors))
    slack = 1e-15 * (len(q) + 1) * np.sqrt((q**2).sum()) * norms
    if len(near) > k:
        take = np.flatnonzero(near + slack >= np.partition(near - slack, len(near) - k)[len(near) - k])
    own = [int(c) for c in q]
    scores = [sum(a * int(c) for a, c in zip(own, vectors[j])) for j in take]
    best = sorted(range(len(take)), key=lambda i: -scores[i])[:k]
    return take[best], np.array([min(max(scores[i], LOWEST), HIGHEST) for i in best], np.int64)


class _Index:
    """The pivots with their distances; small, of bounded size, broadcast."""

    def __init__(self, pivots: list[bytes], width: int, top: float):
        self.width, self.top = width, top
        self.pivots = _matrix(pivots, width)
        norms = (self.pivots**2).sum(axis=1)
        self.extra = np.sqrt(np.maximum(top - norms, 0))
        self.slack = 1e-7 * (1 + 4 * top) * max(1, width) ** 0.5

    def keys(self, v: np.ndarray, norm2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.sqrt(np.maximum(self.top - norm2, 0))
        square = 2 * self.top - 2 * (v @ self.pivots.T + np.outer(extra, self.extra))
        distance = np.sqrt(np.maximum(square, 0))
        pivot = distance.argmin(axis=1)
        return pivot, distance[np.arange(len(v)), pivot]

    def bounds(self, q: np.ndarray, norm2: np.ndarray, rings) -> np.ndarray:
        """Upper bounds of the products of queries (rows) with annuli (columns)."""
        square = norm2[:, None] + self.top - 2 * (q @ self.pivots.T)
        distance = np.sqrt(np.maximum(square, 0))[:, rings["pivot"]]
        least = np.maximum(0, np.maximum(distance - rings["hi"][None], rings["lo"][None] - distance))
        return (norm2[:, None] + self.top - least**2) / 2 + self.slack


def _key(index):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            v = _matrix(batch.column(2).to_pylist(), own.width)
            pivot, distance = own.keys(v, batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot, pa.int32()), pa.array(distance)],
                ["row", "vec_id", "v", "norm2", "pivot", "distance"],
            )

    return run


def _first(index, rings, k: int):
    """The annuli that each query visits first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, all_ = index.value, rings.value
        for batch in batches:
            bound = own.bounds(_matrix(batch.column(2).to_pylist(), own.width), batch.column(3).to_numpy(), all_)
            order = np.argsort(-bound, axis=1, kind="stable")
            seen = np.cumsum(all_["n"][order], axis=1) - all_["n"][order]
            first = [all_["ring"][o[s < FIRST + k]].tolist() for o, s in zip(order, seen)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.list_(pa.int32()))],
                                             ["q", "query_id", "v", "norm2", "first"])

    return run


def _later(index, rings):
    """The annuli left whose bound reaches the query's k-th best product. Bounds
    may differ in their last bit between runs, so the first annuli are given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, all_ = index.value, rings.value
        for batch in batches:
            bound = own.bounds(_matrix(batch.column(2).to_pylist(), own.width), batch.column(3).to_numpy(), all_)
            go = bound >= batch.column(5).to_numpy()[:, None]
            for i, first in enumerate(batch.column(4).to_pylist()):
                go[i, np.isin(all_["ring"], first)] = False
            at, ring = np.nonzero(go)
            rows = batch.select(["q", "query_id", "v", "least"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(all_["ring"][ring], pa.int32())],
                                             ["q", "query_id", "v", "least", "ring"])

    return run


def _best(width: int, k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            vectors = vectors.sort_values(["vec_id", "row"])
            x, y = _matrix(queries["v"].tolist(), width), _matrix(vectors["v"].tolist(), width)
            scores, norms = _products(x, y), np.sqrt((y**2).sum(axis=1))
            rows, ids = vectors["row"].to_numpy(), vectors["vec_id"].to_numpy()
            least = queries["least"].to_numpy()
            for i, (q, query_id) in enumerate(zip(queries["q"], queries["query_id"])):
                take = np.flatnonzero(rows != q)
                if scores is None:
                    at, own = _leading(x[i], y[take], norms[take], k)
                    take = take[at]
                else:
                    own = scores[i, take]
                    if len(own) > k:
                        edge = np.partition(own, len(own) - k)[len(own) - k]
                        take = take[own >= edge]  # ties in the order of ids
                        take = take[np.argsort(-scores[i, take], kind="stable")][:k]
                        own = scores[i, take]
                reach = own >= least[i]
                take, own = take[reach], own[reach]
                out["q"] += [q] * len(take)
                out["query_id"] += [query_id] * len(take)
                out["vec_id"] += ids[take].tolist()
                out["score"] += own.tolist()
        return pd.DataFrame(out, dtype="int64")

    return run


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """-> (query_id, rank, vec_id, score): for each row whose vec_id is divisible by
    `every`, the k rows of the largest inner product of components
    floor(scale * x), ties to the smaller vec_id (null last); fewer rows, fewer
    ranks.

    A row is not its own candidate; other rows that repeat its vec_id or vector
    are. A vector that is null or holds a null, a NaN or an infinity takes no part.
    Products are exact at any size; a result whose score is beyond a long is an
    error, as in SQL. Vectors of unequal length are compared as if filled with
    zeros. No vectors: no rows. Other columns are ignored.
    """
    spark, context = vectors.sparkSession, vectors.sparkSession.sparkContext
    x = F.transform("embedding", lambda c: c.cast("double") * scale)
    finite = lambda c: F.abs(c.cast("double")) < float("inf")  # noqa: E731  NaN is above all
    fit = F.forall("embedding", lambda c: F.coalesce(finite(c), F.lit(False)))
    rows = cut(
        vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull()).filter(fit).select("vec_id", x.alias("x"))
        .mapInArrow(_pack, "vec_id long, v binary, norm2 double, width int")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    )
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = rows.agg(F.max("width").alias("width"), F.max("norm2").alias("top")).first()
    if size.top is None:
        return empty
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(PIVOTS)
    index = _Index([bytes(r.v) for r in sample.collect()], size.width, size.top)
    shared = context.broadcast(index)
    keyed = cut(
        rows.select("row", "vec_id", "v", "norm2")
        .mapInArrow(_key(shared), "row long, vec_id long, v binary, norm2 double, pivot int, distance double")
    )
    steps = [i / RINGS for i in range(1, RINGS)]
    # worked out once: approximate percentiles may differ from one run to the next
    edges = cut(keyed.groupBy("pivot").agg(F.percentile_approx("distance", steps, 1000).alias("edges")))
    ringed = keyed.join(F.broadcast(edges), "pivot").withColumn(  # PIVOTS rows
        "ring",
        (F.col("pivot") * RINGS + F.size(F.filter("edges", lambda e: e < F.col("distance")))).cast("int"),
    ).drop("edges")
    found = ringed.groupBy("pivot", "ring").agg(
        F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n")
    ).collect()
    rings = {name: np.array([r[name] for r in found]) for name in ("pivot", "ring", "lo", "hi", "n")}
    shared_rings = context.broadcast(rings)
    parts = F.create_map(*[F.lit(v) for r in found for v in (r.ring, -(-r.n // VECTORS))])
    part = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    stored = ringed.select("row", "vec_id", "v", "ring", part("row", parts[F.col("ring")]).alias("part"))
    queries = cut(
        rows.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID))
        .select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "v", "norm2")
        .mapInArrow(_first(shared, shared_rings, k), "q long, query_id long, v binary, norm2 double, first array<int>")
    )
    blocks = max(1, -(-queries.count() // QUERIES))

    def visit(asked: DataFrame) -> DataFrame:
        every_part = F.explode(F.sequence(F.lit(0), (parts[F.col("ring")] - 1).cast("int")))
        asked = asked.select("q", "query_id", "v", "least", "ring", part("q", F.lit(blocks)).alias("block"), every_part.alias("part"))
        met = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ["ring", "part", "block"]
        return asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(
            _best(index.width, k), "q long, query_id long, vec_id long, score long"
        )

    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    visited = queries.select("q", "query_id", "v", F.lit(LOWEST).alias("least"), F.explode("first").alias("ring"))
    first = cut(visit(visited))
    ranks = first.withColumn("rank", F.row_number().over(ranked))
    least = ranks.filter(F.col("rank") == k).select("q", F.col("score").alias("least"))
    # never null: pandas would turn longs beside nulls into doubles
    known = F.coalesce("least", F.lit(LOWEST)).alias("least")
    asked = queries.join(least, "q", "left").select("q", "query_id", "v", "norm2", "first", known)
    rest = visit(asked.mapInArrow(_later(shared, shared_rings), "q long, query_id long, v binary, least long, ring int"))
    beyond = F.col("score").isin(LOWEST, HIGHEST)
    score = F.when(beyond, F.raise_error(F.lit("a score is beyond a long")).cast("long")).otherwise(F.col("score"))
    return (
        first.union(rest).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        .select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), score.alias("score"))
    )


def op6_pivot_distance(spark, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS rank
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
) WHERE rank <= 5
"""
