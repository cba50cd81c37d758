"""Token counts through a digest cache.

A cache table holds (version, digest, n_tokens): `version` is the digest of the
tokenizer's file, `digest` that of a text's normalised content. Texts of a run
are reduced to distinct digests, the cache is joined, one text of each missing
digest is encoded, and the new counts are appended for later runs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.encode import encoder, tokenizer_path
from catalogspark.llm.frames import new_path, slices, table, texts
from catalogspark.session import cut

CACHE = "digest binary, n_tokens long, version string"


def version_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:32]


def _normal(text: Column, path: str) -> Column:
    """What a text's count depends on. The word-level file drops white space, so
    runs of it are one blank there; for other files it's the text itself."""
    text = F.coalesce(text, F.lit(""))
    if os.path.basename(path).startswith("word_"):
        text = F.regexp_replace(text, "[ \\t\\n\\r\\x0B\\f]+", " ")
    return text


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    return lambda texts: [len(ids) // 4 for ids in encoder(path).encode(texts)]


def _encode_batches(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in slices(batches, 1):
            n = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str = "word_bpe_49k.json", limit: int = 2048
) -> DataFrame:
    """-> (doc_id, n_bytes, n_tokens, over_limit), a row for each row of `docs`.

    `cache` is the cache table's path, made when it isn't there. `tokenizer` is
    a file of the public tokenizers, `.json` or `.model`. A null text counts as
    empty: no bytes, no tokens. Rows may repeat and doc_id may be null; other
    columns of `docs` are ignored. `over_limit` is n_tokens > limit.

    Only digests are aggregated; of texts, one for each missing digest is
    counted. The appended files are committed as a whole, so a lost executor or
    a failed run leaves either all new counts or none; two runs that append the
    same digest agree, and reading takes one.
    """
    spark = docs.sparkSession
    path = tokenizer if os.path.sep in tokenizer else tokenizer_path(tokenizer)
    version = version_of(path)
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("version").parquet(cache)
    stored = (
        spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    normal = _normal(F.col("text"), path)
    digest = F.unhex(F.sha2(normal, 256)).alias("digest")
    docs = texts(docs)
    keyed = cut(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest))
    missing = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti")
    wanted = missing.select(F.col("digest").alias("d"), F.col("doc_id").alias("i")).hint("shuffle_hash")
    chosen = (
        docs.select("doc_id", digest, normal.alias("text"))
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")
        .select("digest", "text")
    )
    new = chosen.mapInArrow(_encode_batches(path), "digest binary, n_tokens long")
    new.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    spark.catalog.refreshByPath(cache)
    stored = (
        spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    return keyed.join(stored, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op10_digest_cache(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents, with a cache of this run's own."""
    return count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-counts"))
