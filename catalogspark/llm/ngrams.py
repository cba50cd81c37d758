"""Grouped prefix join: documents whose word shingles overlap by Jaccard.

1. A fixed-size table of shingle counts over all documents orders shingles by
   rarity (ties by hash). Two sets that reach the threshold share one of the
   first n - ceil(t * n) + 1 shingles of both in any common order.
2. Documents of equal sets are one class; classes of equal prefix and size are
   one group, and only groups post their prefixes.
3. Every prefix shingle links its groups to its first one (by place in the
   prefix), so a bucket of m groups gives m pairs. Length, place, and a parity
   bitmap of the sets bound each pair's overlap; the rest is verified on whole
   sets, and the links found are contracted to components.
4. In buckets that still hold several components, members of different
   components are paired, in blocks of bounded size, and verified as well.

Step 4 covers every pair that step 3 left between components, so no link that
could join two components is lost, while copies of one text, however many, are
never paired with one another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.components import components
from catalogspark.llm.frames import slices, table, texts
from catalogspark.llm.shingles import BLANKS, Words, mix, sets
from catalogspark.session import cut

U = np.uint64
#: Counters of the rarity table (4 bytes each, broadcast) and of its parts.
COUNTERS, PART = 1 << 20, 1 << 12
#: Slots of the filter that marks the documents whose sets are wanted.
SLOTS = 1 << 21
#: Members of a bucket that meet in one block.
BLOCK = 512


def _count_shingles(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches, 0):
            hashes, _ = Words(batch.column(0), BLANKS).shingles(size)
            counts += np.bincount((hashes & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        parts = counts.reshape(-1, PART)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int64()), pa.array([p.astype("<i8").tobytes() for p in parts[full]], pa.binary())],
            ["part", "counts"],
        )

    return run


def _add_parts(pdf):
    total = sum(np.frombuffer(c, "<i8") for c in pdf["counts"])
    return pdf.iloc[:1].assign(counts=[total.astype("<i8").tobytes()])


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How often the shingles of each counter occur in all of `docs`; the table's
    size doesn't depend on the data."""
    schema = "part long, counts binary"
    found = docs.select("text").mapInArrow(_count_shingles(size), schema)
    counts = np.zeros((COUNTERS // PART, PART), np.uint32)
    for row in found.groupBy("part").applyInPandas(_add_parts, schema).collect():
        counts[row.part] = np.minimum(np.frombuffer(row.counts, "<i8"), (1 << 32) - 1)
    return counts.reshape(-1)


def _signature(own: np.ndarray) -> tuple[int, int]:
    """Of a set, whatever the order: two sums of mixed hashes."""
    return (
        int(mix(own ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64)),
        int(mix(own + U(0x14057B7EF767814F)).sum(dtype=U).view(np.int64)),
    )


def _parity(own: np.ndarray) -> bytes:
    """Bit i is the parity of the number of elements dealt to i; about half as
    many bits as elements, a power of two."""
    bits = max(64, 1 << (max(1, len(own) // 2 - 1)).bit_length())
    dealt = np.bincount((own >> U(40)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((dealt & 1).astype(bool)).tobytes()


def _describe(size: int, percent: int, counts):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = counts.value
        for batch in slices(batches, 1):
            n, ends, prefixes, bits = [], [0], [], []
            sig1, sig2, p1, p2 = [], [], [], []
            for own in sets(Words(batch.column(1), BLANKS), size):
                n.append(len(own))
                first, second = _signature(own)
                sig1.append(first)
                sig2.append(second)
                keep = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                order = np.argsort(table_[(own & U(COUNTERS - 1)).astype(np.int64)], kind="stable")[:keep]
                prefixes.append(own[order].view(np.int64))
                first, second = _signature(own[order])
                p1.append(first)
                p2.append(second)
                ends.append(ends[-1] + keep)
                bits.append(_parity(own))
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(x, pa.int64()) for x in (n, sig1, sig2, p1, p2)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64())),
                    pa.array(bits, pa.binary()),
                ],
                ["doc_id", "n", "sig1", "sig2", "p1", "p2", "prefix", "bits"],
            )

    return run


def _wanted_sets(size: int, slots):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = slots.value
        for batch in slices(batches, 1):
            ids = batch.column(0)
            own_ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            keep, sig1, sig2, found = [], [], [], []
            for i, own in enumerate(sets(Words(batch.column(1), BLANKS), size)):
                first, second = _signature(own)
                if marked[(first ^ int(own_ids[i])) & (SLOTS - 1)] and len(own):
                    keep.append(i)
                    sig1.append(first)
                    sig2.append(second)
                    found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(keep, pa.int64())), pa.array(sig1, pa.int64()), pa.array(sig2, pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "sig1", "sig2", "own"],
            )

    return run


def _fold(bits: bytes, to: int) -> np.ndarray:
    own = np.frombuffer(bits, np.uint8)
    return np.bitwise_xor.reduce(own.reshape(-1, to), axis=0) if len(own) > to else own


def _bounded(percent: int):
    """Keeps pairs whose bitmaps allow the overlap: each bit that differs is an
    element that only one of the two has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch.column(i).to_numpy() for i in (2, 3))
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                to = min(len(x), len(y))
                differ = int(np.bitwise_count(_fold(x, to) ^ _fold(y, to)).sum())
                both = int(n1[i] + n2[i])
                keep[i] = (both - differ) // 2 * (100 + percent) >= percent * both
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _possible(percent: int, n1: Column, n2: Column, at1: Column, at2: Column) -> Column:
    """Length and place: what may follow the first common shingle is enough."""
    most = F.least(n1 - at1, n2 - at2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (most * (100 + percent) >= percent * (n1 + n2))


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = texts(docs), size, percent
        self.context = docs.sparkSession.sparkContext

    def described(self) -> DataFrame:
        """A row for each document: its set's size, signature, prefix (with a
        signature of its own) and bitmap."""
        counts = self.context.broadcast(rarity(self.docs, self.size))
        return cut(
            self.docs.mapInArrow(
                _describe(self.size, self.percent, counts),
                "doc_id long, n long, sig1 long, sig2 long, p1 long, p2 long, prefix array<long>, bits binary",
            ).withColumn("row", F.monotonically_increasing_id())
        )

    def verified(self, pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose whole sets reach the threshold."""
        bits = rows.select(F.col("row").alias("node"), "n", "bits")
        left = bits.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("b1"))
        right = bits.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
        close = cut(
            pairs.join(left, "a").join(right, "b").select("a", "b", "n1", "n2", "b1", "b2")
            .mapInArrow(_bounded(self.percent), "a long, b long")
        )
        nodes = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
        wanted = cut(classes.join(nodes, "node").select("node", "doc_id", "sig1", "sig2"))
        slot = F.col("sig1").bitwiseXOR(F.coalesce("doc_id", F.lit(0))).bitwiseAND(F.lit(SLOTS - 1))
        marked = np.zeros(SLOTS, bool)
        marked[wanted.select(slot.alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
        found = self.docs.mapInArrow(
            _wanted_sets(self.size, self.context.broadcast(marked)),
            "doc_id long, sig1 long, sig2 long, own array<long>",
        )
        w = wanted.select("node", F.col("doc_id").alias("i"), F.col("sig1").alias("s1"), F.col("sig2").alias("s2"))
        own = cut(
            found.join(w, (F.col("sig1") == F.col("s1")) & (F.col("sig2") == F.col("s2")) & F.col("doc_id").eqNullSafe(F.col("i")))
            .groupBy("node").agg(F.first("own").alias("own"))
        )
        checked = close.join(own.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(
            own.select(F.col("node").alias("b"), F.col("own").alias("y")), "b"
        )
        both = F.size(F.array_intersect("x", "y"))
        return checked.filter(both * (100 + self.percent) >= self.percent * (F.size("x") + F.size("y"))).select("a", "b")

    def links(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes above the threshold that connect all that the
        threshold connects. Nodes and groups are named by the row of a document,
        so prefixes and bitmaps are read from `rows` and kept nowhere else."""
        groups = classes.groupBy("n", "p1", "p2").agg(F.min("node").alias("gid"), F.count("*").alias("m"))
        members = cut(classes.join(groups.filter("m > 1"), ["n", "p1", "p2"]).select("gid", "node"))
        posted = rows.select(F.col("row").alias("gid"), "n", "prefix").join(groups.select("gid"), "gid", "left_semi")
        posted = posted.select("gid", "n", F.posexplode("prefix").alias("at", "token"))
        tokens = posted.groupBy("token").agg(
            F.min(F.struct("at", "gid", "n")).alias("top"), F.count("*").alias("c")
        )
        shared = cut(posted.join(tokens.filter("c > 1"), "token"))
        col = F.col
        pairs = (
            shared.filter(col("gid") != col("top.gid"))
            .filter(_possible(self.percent, col("top.n"), col("n"), col("top.at"), col("at")))
            .select(F.least("top.gid", "gid").alias("a"), F.greatest("top.gid", "gid").alias("b"))
        )
        tried = cut(pairs.union(members.filter("gid <> node").select("gid", "node")).distinct())
        near = cut(self.verified(tried, rows, classes))
        comps = components(near)

        # members of buckets that are still in several components
        joined = shared.select("token", "gid", "n", "at").join(members, "gid", "left")
        group = members.groupBy("gid").agg(F.count("*").alias("m"))  # one shingle posted by one group of several
        alone = (
            posted.join(group, "gid").join(tokens.filter("c = 1").select("token"), "token")
            .select("token", "gid", "n", "at").join(members, "gid")
        )
        joined = joined.select("token", "n", "at", F.coalesce("node", "gid").alias("node")).union(
            alone.select("token", "n", "at", "node")
        )
        joined = cut(
            joined.join(comps, "node", "left").select("token", "n", "at", "node", F.coalesce("comp", "node").alias("comp"))
        )
        open_ = joined.groupBy("token").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK).alias("k")
        ).filter("low < high")
        own = F.pmod(F.xxhash64("node"), F.col("k"))
        rest = joined.join(open_.select("token", "k"), "token").withColumn("own", own)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
        left = rest.select("token", "comp", col("node").alias("a"), col("n").alias("n1"), col("at").alias("at1"), col("own").alias("i"), other.alias("j"))
        right = rest.select("token", col("comp").alias("comp2"), col("node").alias("b"), col("n").alias("n2"), col("at").alias("at2"), other.alias("i"), col("own").alias("j"))
        pairs = (
            left.join(right, ["token", "i", "j"])
            .filter((col("a") < col("b")) & (col("comp") != col("comp2")))
            .filter(_possible(self.percent, col("n1"), col("n2"), col("at1"), col("at2")))
            .select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        )
        return near.union(cut(self.verified(pairs, rows, classes)))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """-> (doc_id, n_shingles, component_id), a row for each row of `docs`.

    A document's set holds its distinct shingles of `size` words
    `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; fewer words, but not none, are one
    shingle. Two documents link when 100 * |x & y| >= percent * |x | y|;
    component_id is the smallest doc_id reachable by links, its own included.

    Without words, or with null text, a document has 0 shingles, no links, and
    its own doc_id. Rows that repeat a doc_id or a text are documents like any
    other. A null doc_id links like others; component_id passes over it, and is
    null where the whole component has none. Other columns are ignored. An empty
    table gives an empty result.
    """
    job = _Join(docs, size, percent)
    rows = job.described()
    classes = cut(
        rows.filter("n > 0").groupBy("n", "sig1", "sig2")
        .agg(F.min(F.struct("row", "doc_id", "p1", "p2")).alias("of"), F.min("doc_id").alias("low"))
        .select("n", "sig1", "sig2", F.col("of.row").alias("node"), "of.doc_id", "of.p1", "of.p2", "low")
    )
    comps = components(job.links(rows, classes))
    named = classes.select("n", "sig1", "sig2", "low", "node").join(comps, "node", "left")
    named = named.withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(smallest, "comp").select("n", "sig1", "sig2", "component_id")
    return rows.select("doc_id", "n", "sig1", "sig2").join(named, ["n", "sig1", "sig2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def op2_grouped_prefix_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


#: Links of all pairs of distinct sets that share a shingle, then reachability.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS ss
  FROM w
), n AS (SELECT doc_id, ss, len(ss) AS n_shingles FROM s
), p AS MATERIALIZED (SELECT doc_id, n_shingles, unnest(ss) AS sh FROM n
), f AS MATERIALIZED (SELECT sh FROM p GROUP BY sh HAVING count(*) > 1
), q AS MATERIALIZED (SELECT p.* FROM p SEMI JOIN f ON p.sh = f.sh
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n_shingles) AS n1, any_value(y.n_shingles) AS n2, count(*) AS c
  FROM q x JOIN q y ON x.sh = y.sh AND x.doc_id <> y.doc_id
    AND 100 * least(x.n_shingles, y.n_shingles) >= 90 * greatest(x.n_shingles, y.n_shingles)
  GROUP BY 1, 2
), e AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * c >= 90 * (n1 + n2 - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT n.doc_id, n.n_shingles, m.component_id
FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id
"""
