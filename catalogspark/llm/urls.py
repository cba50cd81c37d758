"""URL filter: rules on hosts and paths, and a classifier of segmented names.

Host labels and path tokens are split into words by Viterbi over a unigram model
of the pages' own words. A multinomial naive Bayes over those words learns from
the URLs that a rule decides and from seed words, and judges all others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.frames import table
from catalogspark.session import cut

#: (verdict, host, path): a rule fits its host and all subdomains, where the path
#: starts with the rule's; the longest host and path wins.
RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]
#: Words of names that no corpus is wanted from: labels for training beside the rules.
SEEDS = [
    "ads", "adult", "bet", "bets", "casino", "cheap", "farm", "free", "pills", "porn", "spam", "track", "win", "xxx",
]
#: Longest word of the unigram model.
LONGEST = 24
#: Buckets of hashed words in naive Bayes.
BUCKETS = 1 << 16
#: What stands between words of a page: tags, what follows the scheme of a URL, and
#: all but ASCII letters.
BETWEEN = "<[^<>]*>|://[^\\s<>\"']*|[^a-z<:]+|[<:]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Unigrams:
    cost: dict[str, float]  # word -> negative log-probability
    unknown: float  # of one more character outside the vocabulary

    def split(self, name: str) -> list[str]:
        """The cheapest words whose concatenation is the name; stretches outside
        the vocabulary cost `unknown` a character and stay together."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            least, start = best[end - 1] + self.unknown, end - 1
            for begin in range(max(0, end - LONGEST), end):
                cost = self.cost.get(name[begin:end])
                if cost is not None and best[begin] + cost < least:
                    least, start = best[begin] + cost, begin
            best.append(least)
            back.append(start)
        words, end, loose = [], len(name), ""
        while end:
            word = name[back[end] : end]
            if word in self.cost:
                words += [loose, word] if loose else [word]
                loose = ""
            else:
                loose = word + loose
            end = back[end]
        return ([loose] if loose else []) + words[::-1]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host stands after the first `://` up to `/`, `?`, `#` or the
    end, A-Z lower-cased; the path from there up to `?`, `#` or the end."""
    whole = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, whole, 1), _UPPER, _LOWER), F.regexp_extract(url, whole, 2)


def decide(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def unigrams(texts: DataFrame, seeds) -> tuple[DataFrame, float]:
    """(word, cost) of all words (runs of ASCII letters) in all of `texts`, outside
    tags and URLs, and the cost of an unknown character. Names don't count: they
    aren't segmented yet, and a host's many paths would make one word of it. Only
    the highest count and the sum of counts reach the driver."""
    lower = F.translate(F.coalesce(F.col(texts.columns[0]), F.lit("")), _UPPER, _LOWER)
    words = texts.select(F.explode(F.split(lower, BETWEEN)).alias("word")).filter(F.length("word").between(2, LONGEST))
    own = texts.sparkSession.createDataFrame([(s,) for s in seeds], "word string")
    counted = cut(
        words.withColumn("n", F.lit(1)).union(own.withColumn("n", F.lit(0))).groupBy("word").agg(F.sum("n").alias("n"))
    )
    least = 1 + (counted.agg(F.max("n")).first()[0] or 0) // 1000
    raised = F.when(F.col("word").isin(list(seeds)), F.greatest("n", F.lit(least))).otherwise(F.col("n"))
    counted = counted.select("word", raised.alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # a word's length counts, so that a long known word beats its short pieces
    cost = F.log(F.lit(float(total or 1))) - F.log("n")
    return counted.select("word", cost.alias("cost")), float(np.log(total + 1))


def _split(unknown: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [
                Unigrams({k["word"]: k["cost"] for k in known or []}, unknown).split(token)
                for token, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["token", "words"])

    return run


def segment(names: DataFrame, words: DataFrame, unknown: float) -> DataFrame:
    """`names` (name, tokens) -> (name, words), the distinct words of each name with
    tokens. Each distinct token is split once, by the words among its substrings."""
    own = cut(names.select("name", F.posexplode("tokens").alias("at", "token")))
    distinct = cut(own.select("token").distinct().withColumn("id", F.monotonically_increasing_id()))
    ends = F.transform(
        F.sequence(F.lit(1), F.length("token")), lambda at: F.substring(F.col("token"), at, F.lit(LONGEST))
    )
    starts = F.transform(F.sequence(F.lit(1), F.length("end")), lambda n: F.left(F.col("end"), n))
    found = distinct.select("id", F.explode(ends).alias("end")).select("id", F.explode(starts).alias("word")).distinct()
    known = found.join(words, "word").groupBy("id").agg(F.collect_list(F.struct("word", "cost")).alias("known"))
    split = distinct.join(known, "id", "left").select("token", "known")
    split = cut(split.mapInArrow(_split(unknown), "token string, words array<string>"))
    bags = own.join(split, "token").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
    return bags.select("name", F.array_distinct(F.flatten("all.words")).alias("words"))


def judge(
    pages: DataFrame, rules=RULES, seeds=SEEDS, alpha: float = 0.5
) -> DataFrame:
    """-> (page_id, host, path, rule, verdict, score, words), a row for each row.

    `rule` is the host and path of the rule that decides, else null, and then the
    verdict is the method's: block where `score`, the posterior of block given
    the words of host and path, is at least a half. Training takes the URLs that
    a rule decides, and those that hold a seed word as blocked; without both
    classes the method allows.

    A url that is null or without `://` has an empty host and path, no words, and
    the prior alone. Names are segmented once for each distinct token. Rows may
    repeat and page_id may be null; other columns but url and html are ignored,
    and html, which only adds words to the unigram model, may be null.
    """
    spark, context = pages.sparkSession, pages.sparkSession.sparkContext
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    rows = cut(rows.withColumn("rule", rule).withColumn("said", verdict))
    names = cut(rows.groupBy("host", "path", "rule", "said").agg(F.count("*").alias("n")).withColumn("name", F.monotonically_increasing_id()))
    words, unknown = unigrams(pages.select("html"), seeds)

    tokens = F.filter(
        F.split(F.translate(F.concat_ws("/", "host", "path"), _UPPER, _LOWER), "[^a-z]+"), lambda t: F.length(t) > 0
    )
    bags = segment(names.select("name", tokens.alias("tokens")), words, unknown)
    none = F.array().cast("array<string>")
    named = cut(names.join(bags, "name", "left").withColumn("words", F.coalesce("words", none)))

    seeded = F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds]))
    label = F.when(seeded, "block").otherwise(F.col("said"))
    known = named.select(label.alias("label"), "n", "words").filter("label is not null")
    docs = {r.label: r.n for r in known.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    counts = (
        known.select("label", "n", F.explode("words").alias("word")).groupBy("label", bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    ).collect()
    table_ = {k: np.full(BUCKETS, alpha) for k in ("block", "allow")}
    for r in counts:
        table_[r.label][r.bucket] += r.n
    both = all(docs.get(k) for k in table_)
    odds = np.log(table_["block"] / table_["block"].sum()) - np.log(table_["allow"] / table_["allow"].sum())
    prior = float(np.log(docs["block"] / docs["allow"])) if both else 0.0
    shared = context.broadcast(odds if both else np.zeros(BUCKETS))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column(1).to_pylist()
            logit = np.array([prior + sum(shared.value[b] for b in own) for own in buckets] or [], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))), pa.float64())], ["name", "score"]
            )

    hashed = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    scores = named.select("name", hashed.alias("buckets")).mapInArrow(score, "name long, score double")
    judged = named.join(scores, "name").select("host", "path", "words", "score")
    method = F.when(F.lit(both) & (F.col("score") >= 0.5), "block").otherwise("allow")
    return rows.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score", "words"
    )


def op7_host_segmentation(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
