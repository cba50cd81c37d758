"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character n-grams of the case-folded text are hashed to a fixed number of
buckets. Training adds up a bucket row for each language over all labelled
rows, in numpy within tasks, and keeps smoothed log-probabilities; that matrix
is broadcast, in blocks of languages where there are many, and texts are scored in
batches, block after block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.llm.frames import slices, table, texts
from catalogspark.session import cut

#: Buckets of hashed n-grams, and the lengths of the n-grams.
BUCKETS, SIZES = 1 << 15, (1, 2, 3)
#: Languages of a block, about: as many as are broadcast and scored at a time.
BLOCK = 256
UNKNOWN = "und"
#: Buckets that are added up together.
PART = 1 << 10
#: Tasks whose counts are added up before those of all are.
TASKS = 1024
#: Characters scored at a time.
CHARS = 1 << 18


@dataclass
class Block:
    languages: list[str]
    log_prob: np.ndarray  # (BUCKETS, languages), float32
    log_prior: np.ndarray


@dataclass
class Model:
    """`counts`: (lang, part, rows, counts, block), a written table; `languages` of
    them in so many `blocks`, `rows` rows in all."""

    counts: DataFrame
    languages: int
    blocks: int
    rows: int
    alpha: float

    def block(self, number: int) -> Block:
        """Some BLOCK languages, their log-probabilities taken among all of theirs."""
        found = self.counts.filter(F.col("block") == number).collect()  # about BLOCK times BUCKETS numbers
        rows_of = {r.lang: r.rows for r in found}
        langs = sorted(rows_of)
        place = {lang: k for k, lang in enumerate(langs)}
        counts = np.full((len(langs), BUCKETS // PART, PART), float(self.alpha))
        for r in found:
            counts[place[r.lang], r.part] += np.frombuffer(r.counts, "<i8")
        counts = counts.reshape(len(langs), BUCKETS).T
        rows = np.array([rows_of[lang] for lang in langs], float)
        return Block(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(rows / max(1, self.rows)))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark on one."""
    return np.array([category(chr(c))[0] in "LM" for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(codes: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each n-gram of so many codes."""
    n = len(codes) - size + 1
    mixed = np.full(n, size, np.uint32)
    for k in range(size):
        mixed = (mixed ^ codes[k : k + n].astype(np.uint32)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return mixed & np.uint32(BUCKETS - 1)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """-> (buckets, text numbers) of all n-grams of the texts; a text begins with a
    blank and every run of other characters than letters is one blank."""
    codes = _codes("\0" + "\0".join(texts).lower())
    number = np.cumsum(codes == 0) - 1
    letter = _letters()[codes]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # the last character before a letter stands for the run
    keep |= codes == 0
    codes, number = np.where(letter, codes, 32)[keep], number[keep]
    buckets, numbers = [], []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        inside = number[:n] == number[size - 1 :] if size > 1 else codes[:n] != 32
        buckets.append(_mixed(codes, size)[inside])
        numbers.append(number[:n][inside])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(numbers)


def _long_grams(text: str) -> Iterator[np.ndarray]:
    """The buckets of one text, as _grams gives them, some CHARS characters at a
    time; the last codes of a piece go before the next one's."""
    text = "\0" + text.lower()
    tail = np.zeros(0, np.uint32)
    for at in range(0, len(text), CHARS):
        codes = _codes(text[at : at + CHARS + 1])  # and the character behind the piece
        letter = _letters()[codes]
        keep = letter.copy()
        keep[:-1] |= letter[1:]
        keep |= codes == 0
        own = len(codes) - 1 if at + CHARS < len(text) else len(codes)
        codes = np.where(letter, codes, 32)[:own][keep[:own]].astype(np.uint32)
        joined = np.concatenate([tail, codes])
        for size in SIZES:
            first = max(0, len(tail) - size + 1)  # n-grams that end in this piece
            if len(joined) - first >= size:
                found = _mixed(joined[first:], size)
                yield found[joined[first:] != 32] if size == 1 else found
        tail = joined[-(max(SIZES) - 1) :]


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """-> (number of the first text, texts, buckets, text numbers from the first) for
    runs of texts of about CHARS characters, NUL taken out; a longer text comes
    alone, in several runs that hold each of its n-grams once."""
    first, held, chars = 0, [], 0
    for i, text in enumerate(texts):
        text = (text or "").replace("\0", " ")
        if len(text) > CHARS:
            if held:
                yield first, len(held), *_grams(held)
            for buckets in _long_grams(text):
                yield i, 1, buckets, np.zeros(len(buckets), np.int64)
            first, held, chars = i + 1, [], 0
            continue
        held.append(text)
        chars += len(text)
        if chars >= CHARS:
            yield first, len(held), *_grams(held)
            first, held, chars = i + 1, [], 0
    if held:
        yield first, len(held), *_grams(held)


def _parts(total: dict[str, np.ndarray], rows: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for lang, counts in total.items():
        parts = counts.astype("<i8").reshape(-1, PART)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(parts), pa.string()), pa.array(np.arange(len(parts)), pa.int64()),
             pa.array([rows[lang]] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
            ["lang", "part", "rows", "counts"],
        )


def _add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in slices(batches, 0):
        langs = np.array(batch.column(1).to_pylist(), object)
        names = list(dict.fromkeys(langs))
        for low in range(0, len(names), BLOCK):  # a batch may hold any number of languages
            some = {lang: k for k, lang in enumerate(names[low : low + BLOCK])}
            mine = [i for i, lang in enumerate(langs) if lang in some]
            of = np.array([some[langs[i]] for i in mine])
            texts = batch.column(0).take(pa.array(mine)).to_pylist()
            counts = np.zeros(len(some) * BUCKETS, np.int64)
            for first, _, buckets, numbers in _pieces(texts):
                counts += np.bincount(of[first + numbers] * BUCKETS + buckets, minlength=len(counts))
            for lang, k in some.items():
                total[lang] = total.get(lang, 0) + counts[k * BUCKETS : (k + 1) * BUCKETS]
                rows[lang] = rows.get(lang, 0) + int((of == k).sum())
            if len(total) >= BLOCK:
                yield from _parts(total, rows)
                total, rows = {}, {}
    yield from _parts(total, rows)


def _sum_up(pdf):
    counts = sum(np.frombuffer(c, "<i8") for c in pdf["counts"])
    return pdf.iloc[:1].assign(rows=[pdf["rows"].sum()], counts=[counts.astype("<i8").tobytes()])


def train(labelled: DataFrame, alpha: float = 0.1) -> Model:
    """A model of all (text, lang) rows whose lang isn't null, with all their
    languages; without such rows it has none."""
    schema = "lang string, part long, rows long, counts binary"
    labelled = labelled.select("text", "lang").filter("lang is not null")
    found = labelled.mapInArrow(_add_up, schema)
    # two steps, so that no group has a row from each of very many tasks
    found = found.withColumn("tasks", F.floor(F.spark_partition_id() / TASKS))
    found = found.groupBy("lang", "part", "tasks").applyInPandas(_sum_up, f"{schema}, tasks long").drop("tasks")
    counts = cut(found.groupBy("lang", "part").applyInPandas(_sum_up, schema))
    n, rows = counts.filter("part = 0").agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    blocks = -(-n // BLOCK)
    return Model(counts.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(max(1, blocks)))), n, blocks, rows, alpha)


def _score(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        width = len(m.languages)
        for batch in slices(batches, 1):
            if not width:  # hashing left this block empty
                yield batch
                continue
            logs = np.tile(m.log_prior, (batch.num_rows, 1)).astype(float)
            for first, n, buckets, numbers in _pieces(batch.column(1).to_pylist()):
                for k in range(width):
                    logs[first : first + n, k] += np.bincount(numbers, m.log_prob[buckets, k], n)
            at = logs.argmax(axis=1)
            best = logs.max(axis=1)
            total = np.exp(logs - best[:, None]).sum(axis=1)
            lang = [m.languages[k] for k in at]
            before = batch.column(3).to_pylist()
            if any(b is not None for b in before):
                old = np.array([-np.inf if b is None else b for b in batch.column(4).to_pylist()])
                sums = np.array([0.0 if b is None else b for b in batch.column(5).to_pylist()])
                top = np.maximum(old, best)
                stay = [b is not None and (o > t or (o == t and b < n)) for b, o, t, n in zip(before, old, best, lang)]
                lang = [b if s else n for b, s, n in zip(before, stay, lang)]
                total, best = total * np.exp(best - top) + sums * np.exp(old - top), top
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(lang, pa.string()), pa.array(best), pa.array(total)],
                ["doc", "text", "letters", "lang_pred", "best", "total"],
            )

    return run


#: Rows that training leaves out.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, false)"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """-> (doc, text, lang_pred, score) for each row, `doc` holding the row's columns
    but text. lang_pred is a language of the model, or `und` with score 0 where
    text is null or holds no letter, or the model has no language. score is the
    posterior of the language. Whole texts are scored, however long; no other
    column is an input."""
    rows = docs.select(
        F.struct(F.lit(0).alias("_row"), *[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("doc"),
        F.col("text").cast("string").alias("text"), F.col("text").rlike("\\p{L}").alias("letters"),
    )
    none = F.lit(None).cast("double")
    found = rows.select("*", F.lit(None).cast("string").alias("lang_pred"), none.alias("best"), none.alias("total"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in found.schema])
    for number in range(model.blocks):
        found = cut(found) if number else found
        block = docs.sparkSession.sparkContext.broadcast(model.block(number))
        found = found.mapInArrow(_score(block), schema)
    known = F.coalesce("letters", F.lit(False)) & F.col("lang_pred").isNotNull()
    return found.select(
        "doc", "text", F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 / F.col("total")).otherwise(0.0).alias("score"),
    )


def identify(docs: DataFrame) -> DataFrame:
    """-> (doc_id, held_out, lang_pred, score), a row for each row of `docs`, by a
    model of its rows with a lang that aren't held out (crc32 of doc_id as text
    modulo 4 is 2; a null doc_id isn't held out). Rows may repeat; an empty table
    gives an empty result; other columns are ignored."""
    rows = texts(docs).withColumn("held_out", F.expr(HELD_OUT))
    labelled = docs.select("doc_id", "text", "lang").filter(~F.expr(HELD_OUT))
    return predict(rows, train(labelled)).select("doc.doc_id", "doc.held_out", "lang_pred", "score")


def op3_naive_bayes(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
