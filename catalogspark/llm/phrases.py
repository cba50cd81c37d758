"""Collocations: phrases that occur more often than their parts explain, counted
through prefix-free parsing.

A text's words are cut into overlapping chunks wherever a window of words has a
hash of a certain kind, so equal passages are cut alike wherever they stand.
Distinct chunks form a dictionary with their frequencies, and phrases are counted
inside the dictionary, weighted. A chunk ends with the window that begins the next
one; a phrase belongs to the chunk that owns its first word, so an overlap is
counted once. Copies cost no more than their parsing.

Phrases are counted by length. One can only reach the least frequency if both its
parts of one word less do, so the frequent phrases of a length are marked in a bit
table of fixed size, by which the next length is filtered before anything is
shuffled. A marked phrase that isn't frequent costs its count; none is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.frames import raw, slices, spread, table
from catalogspark.llm.shingles import mix, sequence
from catalogspark.llm.spans import FOLD, gather, strings, word_spans
from catalogspark.session import cut

U = np.uint64
#: Longest phrase, in words; chunks overlap by one word less.
LONGEST = 4
#: One window of words in so many begins a chunk; no chunk owns more than MOST words.
EVERY, MOST = 24, 256
#: Bits of the table of frequent phrases, as a power of two.
BITS = 27
#: Bytes of chunks whose phrases a task adds up before they are shuffled.
TOGETHER = 1 << 22

_ENDS = np.isin(np.arange(256), [*b".,;:!?\n\x0b\x0c\r"])
_BLANKS = np.isin(np.arange(256), [32, 9])
_GAPS = _ENDS | _BLANKS
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_BASE = 0x9E3779B97F4A7C15 | 1


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: its bytes' values weighted by powers over their
    places from the end."""
    out = np.empty(len(starts), U)
    total = np.cumsum(ends - starts)
    low = 0
    while low < len(starts):
        base = int(total[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(total, base + (1 << 20), "right")))
        lengths = ends[low:high] - starts[low:high]
        flat, at = gather(data, starts[low:high], lengths)
        power = _powers(int(lengths.max()))
        distance = np.repeat(at + lengths - 1, lengths) - np.arange(len(flat))
        sums = np.add.reduceat(_BYTE[flat] * power[distance], at)
        out[low:high] = mix(sums + lengths.astype(U))
        low = high
    return out


_POWERS = np.cumprod(np.concatenate([np.ones(1, U), np.full(4095, _BASE, U)]))


def _powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, _BASE, U)]))


# Parsing --------------------------------------------------------------------


def _chunks(array: pa.Array, every: int, longest: int, most: int):
    """-> (value of each chunk, number of words it owns, its text). Words are joined
    by a blank, or by a line feed where a piece ends between them."""
    data, at = raw(array)
    data = FOLD[data]
    starts, ends, first = word_spans(data, at, _GAPS)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    flat, places = gather(np.append(data, np.uint8(32)), starts, ends - starts + 1)
    stops = places + (ends - starts)
    sharp = np.concatenate([[0], np.cumsum(_ENDS[data])])
    follow = np.append(starts[1:], len(data))
    flat[stops] = np.where(sharp[np.maximum(follow, ends)] > sharp[ends], 10, 32)
    hashes = _word_hashes(flat, places, stops)
    over, n = longest - 1, len(hashes)
    window = max(over, 1)
    last = np.repeat(first[1:], np.diff(first))  # behind the last word of each word's text
    begins = np.zeros(n, bool)
    if n >= window:
        windows = sequence([hashes[k : n - window + 1 + k] for k in range(window)])
        begins[: n - window + 1] = windows % U(every) == 0
    place = np.arange(n)
    begins &= place + window <= last
    begins[first[:-1][np.diff(first) > 0]] = True
    # a run without such a window is cut every `most` words
    since = place - np.maximum.accumulate(np.where(begins, place, 0))
    begins |= since % most == 0
    head = np.flatnonzero(begins)
    tail = np.append(head[1:], n)
    owned = tail - head
    stop = np.minimum(tail + over, last[head])
    value = np.searchsorted(first, head, "right") - 1
    return value, owned.astype(np.int32), strings(flat, places[head], stops[stop - 1])


def _parse(every: int, longest: int, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            value, owned, text = _chunks(batch.column(1), every, longest, most)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(value)), pa.array(owned), text.cast(pa.string())], ["lang", "owned", "chunk"]
            )

    return run


def dictionary(docs: DataFrame, every: int = EVERY, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """-> (lang, owned, chunk, frequency): the distinct chunks of all texts, by
    language (null: `und`). A chunk's first `owned` words are its own, those behind
    belong to the next one."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    chunks = own.mapInArrow(_parse(every, longest, most), "lang string, owned int, chunk string")
    return chunks.groupBy("lang", "owned", "chunk").agg(F.count("*").alias("frequency"))


# Counting -------------------------------------------------------------------


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64)


def _seeds(langs: pa.Array) -> np.ndarray:
    """A hash for the language of each row."""
    coded = langs.dictionary_encode()
    names = coded.dictionary
    data, at = raw(names)
    named = np.zeros(len(names), U)
    for i in range(len(names)):
        own = data[at[i] : at[i + 1]]
        named[i] = (_BYTE[own] * _powers(max(len(own), 1))[: len(own)]).sum(dtype=U) + U(len(own))
    return mix(named)[coded.indices.to_numpy(zero_copy_only=False)]


def _phrases(size: int, bits: int, marked: np.ndarray | None):
    """(lang, phrase, n) of the phrases of `size` words that a chunk owns, added up
    over TOGETHER bytes; only those both of whose parts are marked."""

    def held(code: np.ndarray) -> np.ndarray:
        return marked[code >> 3] >> (code & 7).astype(np.uint8) & 1 == 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, TOGETHER):
            data, at = raw(batch.column(2))
            langs = batch.column(0).dictionary_encode()
            starts, ends, first = word_spans(data, at, _GAPS)
            hashes = _word_hashes(data, starts, ends)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            owned = batch.column(1).to_numpy()
            seed = _seeds(batch.column(0))
            n = len(starts) - size + 1
            if n <= 0:
                continue
            place = np.arange(len(starts))
            # a phrase begins at an owned word and crosses no end of a piece or chunk
            good = (place - first[row] < owned[row])[:n]
            good &= row[size - 1 :] == row[:n]
            closed = np.concatenate([[0], np.cumsum(data[np.minimum(ends, len(data) - 1)] == 10)])
            good &= closed[size - 1 : size - 1 + n] == closed[:n]
            at_ = np.flatnonzero(good)
            if marked is not None and len(at_):
                for shift in (0, 1):
                    code = _bit(mix(sequence([hashes[at_ + shift + k] for k in range(size - 1)]) ^ seed[row[at_]]), bits)
                    at_ = at_[held(code)]
            if not len(at_):
                continue
            code = sequence([hashes[at_ + k] for k in range(size)]) ^ seed[row[at_]]
            _, lead, which = np.unique(code, return_index=True, return_inverse=True)
            weight = np.zeros(len(lead), np.int64)
            np.add.at(weight, which, batch.column(3).to_numpy()[row[at_]])
            chosen = at_[lead]
            text = strings(data, starts[chosen], ends[chosen + size - 1])
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(row[chosen])).cast(pa.string()), text.cast(pa.string()), pa.array(weight)], ["lang", "phrase", "n"]
            )

    return run


def _marks(size: int, bits: int):
    """Bits of phrases, gathered to words of 64."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, at = raw(batch.column(1))
            starts, ends, first = word_spans(data, at, _GAPS)
            hashes = _word_hashes(data, starts, ends)
            seed = _seeds(batch.column(0))
            code = _bit(mix(sequence([hashes[first[:-1] + k] for k in range(size)]) ^ seed), bits)
            word, which = np.unique(code >> 6, return_inverse=True)
            value = np.zeros(len(word), U)
            np.bitwise_or.at(value, which, U(1) << (code & 63).astype(U))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    return run


def _bit_table(frequent: DataFrame, size: int, bits: int) -> np.ndarray:
    """2 ** bits bits, those of the phrases set; at most so many reach the driver."""
    words = frequent.select("lang", "phrase").mapInArrow(_marks(size, bits), "word long, bits long")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def frequent_phrases(chunks: DataFrame, least: int, longest: int = LONGEST, bits: int = BITS) -> list[DataFrame]:
    """For each length from 1 to `longest`, (lang, phrase, f) of the phrases that occur
    at least `least` times; `chunks` as of `dictionary`, stored."""
    out: list[DataFrame] = []
    spark = chunks.sparkSession
    for size in range(1, longest + 1):
        marked = spark.sparkContext.broadcast(_bit_table(out[-1], size - 1, bits)) if out else None
        found = chunks.mapInArrow(_counted(size, bits, marked), "lang string, phrase string, n long")
        found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        out.append(cut(found))
        if marked is not None:
            marked.destroy()
    return out


def _counted(size: int, bits: int, marked):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _phrases(size, bits, None if marked is None else marked.value)(batches)

    return run


# Scores ---------------------------------------------------------------------


def _brought(rows: DataFrame, counts: DataFrame, name: str, parts: int) -> DataFrame:
    """`rows` with the count of (lang, part `name`). Rows of one part are dealt out
    and its count is brought to each place that has any, so that a frequent word
    gathers nothing."""
    dealt = rows.withColumn("_at", F.pmod(F.xxhash64("phrase", "k"), F.lit(parts)))
    needed = dealt.select("lang", F.col(name).alias("phrase"), "_at").distinct()
    needed = needed.groupBy("lang", "phrase").agg(F.collect_list("_at").alias("_places"))
    own = counts.join(needed, ["lang", "phrase"]).select(
        "lang", F.col("phrase").alias(name), F.explode("_places").alias("_at"), F.col("f").alias(f"{name}_f")
    )
    return dealt.join(own, ["lang", name, "_at"]).drop("_at", name).withColumnRenamed(f"{name}_f", name)


def _joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame, least: int = 30, longest: int = LONGEST, top: int = 2000, inside: int = 80,
    every: int = EVERY, most: int = MOST, bits: int = BITS,
) -> DataFrame:
    """-> (lang, rank, phrase, a, l, r, n, score): for each language (null: `und`) the
    first `top` phrases of 2 to `longest` words that occur a >= `least` times within
    pieces (texts between `.,;:!?` and line ends; words are parted by blanks and tabs,
    A-Z lower-cased).

    Cut behind any of its words, a phrase has parts that occur l and r times and the
    score floor(2000000 * a / (l + r)); the cut with the lowest score counts, the
    first of equal ones. A phrase goes if a longer one of the candidates holds its
    words and occurs in at least `inside` per cent of its places. Order: score, then
    a, both descending, then the phrase's bytes; n is the number of all words.

    A null or empty text has no words, repeated rows count each, other columns are
    ignored, no rows: no phrases. `every`, `most` and `bits` change costs alone.
    Phrases of one task are told apart by 64-bit hashes, all others as text.
    """
    parts = spread(docs.sparkSession)
    chunks = cut(dictionary(docs, every, longest, most))
    words = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("frequency")).cast("long").alias("n"))
    found = frequent_phrases(chunks, least, longest, bits)
    counts = reduce(DataFrame.unionByName, found)
    longer = reduce(DataFrame.unionByName, found[1:]) if longest > 1 else found[0].limit(0)
    split = F.split("phrase", " ")
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), split.alias("words")).select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    )
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        _joined(F.col("words"), F.lit(1), F.col("k")).alias("l"),
        _joined(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("r"),
    )
    cuts = _brought(_brought(cuts, counts, "l", parts), counts, "r", parts)
    score = F.expr("cast((2000000 * cast(a as decimal(38,0))) div (cast(l as decimal(38,0)) + r) as long)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # the most places that a longer phrase takes of each phrase within it
    within = longer.select("lang", F.col("f"), split.alias("words")).filter(F.size("words") > 2)
    within = within.select("lang", "f", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    within = within.select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    within = within.groupBy("lang", _joined(F.col("words"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("most"))
    kept = scored.join(within, ["lang", "phrase"], "left").filter(
        F.expr(f"most is null or cast(100 as decimal(38,0)) * most < cast({int(inside)} as decimal(38,0)) * a")
    )
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = "order by score desc, a desc, phrase"
    # first among the phrases of a part of each language, then among those left
    first = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = first.withColumn("_rank", F.expr(f"row_number() over (partition by lang, _part {order})")).filter(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang {order}) as long)")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_prefix_free_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang
), grams AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS ws
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, ws, count(*) AS f FROM grams GROUP BY lang, k, ws HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.ws, c.k, c.f AS a, x.f AS l, y.f AS r, j,
         CAST(CAST(2000000 AS HUGEINT) * c.f // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, j)
  JOIN f y ON y.lang = c.lang AND y.ws = list_slice(c.ws, j + 1, c.k)
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1
), within AS (
  SELECT lang, list_slice(ws, i, i + s - 1) AS ws, max(f) AS most
  FROM (SELECT lang, ws, f, s, unnest(range(1, k - s + 2)) AS i
        FROM (SELECT *, unnest(range(2, k)) AS s FROM f WHERE k > 2))
  GROUP BY 1, 2
), kept AS (
  SELECT s.lang, array_to_string(s.ws, ' ') AS phrase, a, l, r, score
  FROM scored s LEFT JOIN within w ON w.lang = s.lang AND w.ws = s.ws
  WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""
