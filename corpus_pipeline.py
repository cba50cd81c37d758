"""A corpus from raw documents: language, lines, near-duplicates, benchmark
passages, packing.

Each stage takes (spark, docs, sf_dir), docs being the table of its predecessor,
and returns a table; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm import decontaminate, language, lines, ngrams, packing
from catalogspark.llm.frames import new_path, table

#: A document whose language is less certain is rejected.
MIN_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; `lang` becomes the recognised one. Rows
    without letters, or with a posterior under MIN_SCORE, go. Without labels
    nothing can be recognised, and only rows without letters go."""
    model = language.train(docs.filter(~F.expr(language.HELD_OUT)))
    if not model.languages:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    judged = language.predict(docs, model)
    own = {"lang": F.col("lang_pred").alias("lang"), "text": F.col("text")}
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(
        *[own.get(c, F.col(f"doc.`{c}`")) for c in docs.columns]
    )


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from `text`; a text that loses all of them goes with them.
    `n_chars` is that of the new text."""
    out = lines.drop_lines(docs).filter((F.col("n_dropped") == 0) | (F.length("doc.text") > 0))
    length = F.when(F.col("n_dropped") > 0, F.length("doc.text").cast("long")).otherwise(F.col("doc.n_chars"))
    return out.select(
        *[length.alias(c) if c == "n_chars" else F.col(f"doc.`{c}`") for c in docs.columns]
    )


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar shingles of five words, the smallest doc_id
    stays. Rows that share a doc_id are one document; rows without one stay, as
    do texts without words."""
    named = ngrams.jaccard_components(docs)
    gone = named.filter(~F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    gone = gone.select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go; rows that share a doc_id with one go with it."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = judged.filter("contaminated").select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_copies", one_of_near_copies),
    ("benchmarks", without_benchmarks),
    ("packing", packed),
]

#: The stages score with learned models and encode with a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
