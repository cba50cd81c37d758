"""Benchmark passages in documents, by a prefix-filtered join of shingles.

Every window of an item must stand in a document whole, so its rarest shingle
must stand there: of a window's shingles, ordered by how often the documents
hold them, one is the necessary prefix. Documents are scanned for those
shingles; the ones found are joined to the windows, bounded by the words that
must stand before and behind them, and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.frames import slices, table, texts
from catalogspark.llm.shingles import MARKS, Words, runs
from catalogspark.session import cut

U = np.uint64
#: Slots of the filter that a document's shingles pass before any is shuffled.
SLOTS = 1 << 22
#: Documents of one frequent shingle are dealt to so many parts of the join.
SALTS = 16


def _windows(window: int, shingle: int):
    """Item texts -> their distinct windows: word hashes, and the hashes of their
    shingles of `shingle` words (of all words, where a window has fewer)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = Words(batch.column(1), MARKS)
            item, found, parts = [], [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = words.hashes[words.first[i] : words.first[i + 1]]
                for at in range(max(1, len(own) - window + 1) if len(own) else 0):
                    inside = own[at : at + window]
                    size = min(shingle, len(inside))
                    item.append(key)
                    found.append(inside.view(np.int64))
                    parts.append(runs(inside, np.array([0, len(inside)]), size)[0].view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, batch.column(0).type), pa.array(found, longs), pa.array(parts, longs)],
                ["item_id", "words", "shingles"],
            )

    return run


def _marked(df: DataFrame, column: str) -> np.ndarray:
    """Slots of the values of a column; the result's size is fixed."""
    slots = df.select(F.col(column).bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).distinct().toArrow()
    marked = np.zeros(SLOTS, bool)
    marked[slots.column(0).to_numpy()] = True
    return marked


def _frequencies(sizes: list[int], slots):
    """Counts of the documents' shingles that the filter lets pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            words = Words(batch.column(0), MARKS)
            for size in sizes:
                hashes, _ = words.shingles(size)
                kept = hashes[slots.value[(hashes & U(SLOTS - 1)).astype(np.int64)]]
                found, counts = np.unique(kept, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], ["shingle", "c"]
                )

    return run


def _candidates(sizes: list[int], reach: int, slots):
    """Each document with its number of words and the places of the shingles that
    the filter lets pass: shingle, word position, and the words around it."""
    place = pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("before", pa.int64()), ("around", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = Words(batch.column(1), MARKS)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for size in sizes:
                hashes, first = words.shingles(size)
                for k in np.flatnonzero(slots.value[(hashes & U(SLOTS - 1)).astype(np.int64)]).tolist():
                    doc = int(np.searchsorted(first, k, "right")) - 1
                    at = int(k - first[doc])
                    low, high = int(words.first[doc]), int(words.first[doc + 1])
                    start = max(low, low + at - reach)
                    around = words.hashes[start : min(high, low + at + reach + 1)].view(np.int64)
                    found[doc].append({"shingle": int(hashes[k].view(np.int64)), "at": at, "before": low + at - start, "around": around})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(found, pa.list_(place))],
                ["doc_id", "n_words", "places"],
            )

    return run


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, per_cent: int = 5
) -> DataFrame:
    """-> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items), a
    row for each row of `docs`.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A window is
    `window` consecutive words of an item; an item of fewer, but not none, is one
    window. n_hit counts the document's words inside any occurrence of a window;
    `items` are the ids of items that have one, as sorted strings. A document is
    contaminated when n_hit > 0 and 100 * n_hit >= per_cent * n_words.

    A null or wordless text has no words and no hits, a null or wordless item no
    windows; a null item_id counts in n_hit but names no item. Repeated rows are
    documents or items like any other; items that repeat an id count as one.
    Other columns are ignored. No items: nothing is hit.
    """
    context = docs.sparkSession.sparkContext
    docs = texts(docs)
    key = dict(items.dtypes)["item_id"]
    windows = cut(
        items.select("item_id", "text").mapInArrow(
            _windows(window, shingle), f"item_id {key}, words array<long>, shingles array<long>"
        )
    )
    distinct = cut(windows.select("words", "shingles").distinct().withColumn("wid", F.monotonically_increasing_id()))
    sizes = sorted(
        r.n for r in distinct.select(F.least(F.size("words"), F.lit(shingle)).alias("n")).distinct().collect()
    )
    parts = distinct.select("wid", F.size("words").alias("length"), F.posexplode("shingles").alias("offset", "shingle"))
    counted = docs.select("text").mapInArrow(
        _frequencies(sizes, context.broadcast(_marked(parts, "shingle"))), "shingle long, c long"
    )
    counted = counted.groupBy("shingle").agg(F.sum("c").alias("c"))
    rarest = (
        parts.join(counted, "shingle", "left")
        .groupBy("wid", "length")
        .agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "shingle", "offset")).alias("least"))
        .filter("least.c > 0")  # else no document holds the window
        .select("wid", "length", "least.shingle", "least.offset")
    )
    prefixes = cut(rarest.join(distinct.select("wid", "words"), "wid"))
    found = cut(
        docs.mapInArrow(
            _candidates(sizes, window, context.broadcast(_marked(prefixes, "shingle"))),
            "doc_id long, n_words long, places array<struct<shingle:long,at:long,before:long,around:array<long>>>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    places = found.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    places = places.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)))
    salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    start = F.col("at") - F.col("offset")
    hits = (
        places.join(salted, ["shingle", "salt"])
        .filter((start >= 0) & (start + F.col("length") <= F.col("n_words")))
        .filter(F.slice("around", F.greatest(F.col("before") - F.col("offset") + 1, F.lit(1)).cast("int"), F.col("length")) == F.col("words"))
        .select("row", "wid", start.alias("start"), (start + F.col("length")).alias("end"))
    )
    hits = cut(hits)
    # words hit: intervals in order, each counted from the end of those before it
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    spans = spans.select("row", n_hit.alias("n_hit"))
    named = distinct.select("wid", "words").join(windows.select("item_id", "words").distinct(), "words")
    named = (
        hits.select("row", "wid").distinct().join(named.select("wid", "item_id"), "wid")
        .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    none = F.array().cast("array<string>")
    out = found.select("row", "doc_id", "n_words").join(spans, "row", "left").join(named, "row", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", none))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= per_cent * F.col("n_words"))).alias("contaminated"),
        "items",
    )


def op5_prefix_filtered_join(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), iw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM iw
), dw AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN sizes ON len(ws) >= n)
), h AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
