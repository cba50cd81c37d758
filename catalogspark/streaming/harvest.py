"""Continuous harvest: snapshot upkeep, health, expiry and live status."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from catalogspark import schema
from catalogspark.operators import ingest, snapshot, visibility
from catalogspark.operators.policy import PolicyConfig, entitle
from catalogspark.schema import NS, CatalogTables, Namespace
from catalogspark.session import checkpoint_root, cut
from catalogspark.sources import responses as R

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Ingest ------------------------------------------------------------------------


ARRIVALS = "node_id string, fetched_at timestamp, cycle_id bigint, version bigint"
REMOVED = "node_id string, upto timestamp"
LOGGED = (
    "node_id string, cycle_id bigint, finished_at timestamp, ok boolean, error string, "
    "duration_ms bigint, version bigint"
)


def _kept(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    """A table of the harvest's folder, empty before its first rows. Reading writes
    nothing, so a store can be read where it can't be written."""
    try:
        return spark.read.schema(columns).parquet(f"{path}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The crawl log that the batches have written."""
    return _kept(spark, path, "crawl_log", LOGGED).drop("version")


def new_deliveries(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """A batch without crawls that earlier batches have logged, however long ago;
    a first delivery counts however late it is. A batch that runs again doesn't
    see its own log. Logs are sorted by cycle, so only what lies between the batch's
    first and last cycle is read of them."""
    spark = batch.sparkSession
    first, last = batch.agg(F.min("cycle_id"), F.max("cycle_id")).first()
    seen = _kept(spark, path, "crawl_log", LOGGED).filter(
        (F.col("version") < batch_id) & F.col("cycle_id").between(first, last)
    )
    return batch.join(seen.select("node_id", "cycle_id").distinct(), ["node_id", "cycle_id"], "left_anti")


def upsert_batch(
    participants: DataFrame,
    path: str,
    max_bytes: int,
    timeout_ms: int,
    after: Callable[[CatalogTables, int], None] | None = None,
    ns: Namespace = NS,
):
    """A foreachBatch function: each crawl is logged once, and the newest good
    response of each node replaces all of that node's rows; failed responses
    change nothing.

    A batch writes its nodes' rows as one version with the time they were fetched.
    Readers take each node's newest by that time, whatever the order of arrival,
    and a batch that is run again writes the same files.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = R.check_responses(new_deliveries(batch, path, batch_id), max_bytes, timeout_ms)
        best = cut(R.latest_good(checked))
        log = R.crawl_log_of(checked).dropDuplicates(["node_id", "cycle_id"])
        log = cut(log)  # before this version's files are replaced
        fresh = ingest.parse(best, participants, ns)
        for name, df in vars(fresh).items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/version={batch_id}")
        arrived = best.select("node_id", "fetched_at", "cycle_id").join(
            fresh.catalogs.select("node_id").distinct(), "node_id", "left_semi"
        )
        arrived.write.mode("overwrite").parquet(f"{path}/arrivals/version={batch_id}")
        log.sortWithinPartitions("cycle_id").write.mode("overwrite").parquet(f"{path}/crawl_log/version={batch_id}")
        if after is not None:
            after(read_current(spark, path), batch_id)

    return run


def read_current(spark: SparkSession, path: str) -> CatalogTables:
    """Each node's rows as last fetched, but for nodes removed since."""
    newest = F.max(F.struct("fetched_at", "cycle_id", "version"))
    arrivals = _kept(spark, path, "arrivals", ARRIVALS).groupBy("node_id").agg(newest.alias("a"))
    removed = _kept(spark, path, "removed", REMOVED).groupBy("node_id").agg(F.max("upto").alias("upto"))
    held = (
        arrivals.join(removed, "node_id", "left")
        .filter(F.col("upto").isNull() | (F.col("a.fetched_at") > F.col("upto")))
        .select("node_id", "a.version")
    )
    tables = {}
    for name in CatalogTables.__dataclass_fields__:
        rows = _kept(spark, path, name, f"{getattr(schema, name.upper())}, version bigint")
        tables[name] = rows.join(held, ["node_id", "version"], "left_semi").drop("version")
    return CatalogTables(**tables)


def remove_nodes(spark: SparkSession, path: str, nodes: DataFrame) -> None:
    """Forget what is held of `nodes`; a response fetched later brings one back."""
    arrivals = _kept(spark, path, "arrivals", ARRIVALS).join(nodes.select("node_id"), "node_id", "left_semi")
    upto = cut(arrivals.groupBy("node_id").agg(F.max("fetched_at").alias("upto")))
    upto.write.mode("append").parquet(f"{path}/removed/version=0")


def expire_nodes(spark: SparkSession, path: str, as_of: str, max_age_secs: float) -> None:
    """Forget nodes whose last success is older than the limit."""
    remove_nodes(spark, path, snapshot.expired_nodes(read_log(spark, path), as_of, max_age_secs))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write what is current, with the log, to the empty folder `to`, without the
    versions it has replaced; go on there and drop the old folder."""
    current = read_current(spark, path)
    for name, df in vars(current).items():
        df.write.parquet(f"{to}/{name}/version=-1")
    arrivals = _kept(spark, path, "arrivals", ARRIVALS).groupBy("node_id").agg(
        F.max(F.struct("fetched_at", "cycle_id")).alias("a")
    )
    arrivals.select("node_id", "a.*").join(
        current.catalogs.select("node_id").distinct(), "node_id", "left_semi"
    ).write.parquet(f"{to}/arrivals/version=-1")
    read_log(spark, path).write.parquet(f"{to}/crawl_log/version=-1")


def start_ingest(
    responses: DataFrame, run, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Run batches at `interval`; a slow batch delays the next one. Without an
    interval, take what is there and stop."""
    writer = responses.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def entitle_after(classes: DataFrame, path: str, cfg: PolicyConfig = PolicyConfig()):
    """For upsert_batch: rewrite the allow-list of the static caller classes."""

    def after(tables: CatalogTables, batch_id: int) -> None:
        allowed = visibility.allow_list(tables, entitle(tables, classes, cfg))
        allowed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return after


# What each batch changes in the allow-list of the static caller classes. A node's
# list is kept under the batch that last changed it.

HELD = "node_id string, gone boolean, batch bigint"


def _lists(spark: SparkSession, path: str, class_type: str) -> DataFrame:
    return _kept(spark, path, "lists", f"class_key {class_type}, node_id string, iri string, batch bigint")


def _held(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(node_id, batch) of the lists that count, those before a batch if given."""
    rows = _kept(spark, path, "held", HELD)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    newest = rows.groupBy("node_id").agg(F.max(F.struct("batch", "gone")).alias("a"))
    return newest.filter("not a.gone").select("node_id", "a.batch")


def entitle_deltas(
    classes: DataFrame, source: str, path: str, cfg: PolicyConfig = PolicyConfig(), ns: Namespace = NS
):
    """For upsert_batch into `source`: write only what a batch changes.

    `deltas` in `path` gets the allow-list rows that came and went, with `change` 1
    and -1; they add up to the whole list. Only nodes that arrived, or that are
    held no longer, are decided; a batch without such nodes writes nothing, and one
    whose nodes are as before neither. A batch that runs again writes the same
    files. Other classes need a folder of their own.
    """
    kind = classes.schema["class_key"].dataType.simpleString()

    def after(tables: CatalogTables, batch_id: int) -> None:
        spark = classes.sparkSession
        held = cut(_held(spark, path, batch_id))
        arrived = _kept(spark, source, "arrivals", ARRIVALS).filter(F.col("version") == batch_id)
        gone = held.join(tables.catalogs.select("node_id"), "node_id", "left_anti")
        changed = cut(arrived.select("node_id").unionByName(gone.select("node_id")).distinct())
        if changed.isEmpty():
            return
        mine = tables.map(lambda _, df: df.join(changed, "node_id", "left_semi"))
        mine = mine.map(lambda _, df: cut(df))
        now = cut(visibility.allow_list(mine, entitle(mine, classes, cfg), ns))
        then = _lists(spark, path, kind).join(held.join(changed, "node_id", "left_semi"), ["node_id", "batch"], "left_semi")
        sides = now.withColumn("change", F.lit(1)).unionByName(then.select(*now.columns, F.lit(-1).alias("change")))
        delta = cut(sides.groupBy("class_key", "node_id", "iri").agg(F.sum("change").cast("int").alias("change")).filter("change <> 0"))
        nodes = cut(delta.select("node_id").distinct())
        if nodes.isEmpty():
            return
        left = now.join(nodes, "node_id", "left_semi")
        left.write.mode("overwrite").parquet(f"{path}/lists/batch={batch_id}")
        delta.write.mode("overwrite").parquet(f"{path}/deltas/batch={batch_id}")
        kept = left.select("node_id").distinct().withColumn("kept", F.lit(True))
        # written last: a list counts once it is named here
        nodes.join(kept, "node_id", "left").select("node_id", F.col("kept").isNull().alias("gone")).write.mode(
            "overwrite"
        ).parquet(f"{path}/held/batch={batch_id}")

    return after


def read_allow_list(spark: SparkSession, path: str, class_type: str = "string") -> DataFrame:
    """(class_key, node_id, iri) as the last batch left it."""
    lists = _lists(spark, path, class_type).join(_held(spark, path), ["node_id", "batch"], "left_semi")
    return lists.select("class_key", "node_id", "iri")


def read_deltas(spark: SparkSession, path: str, class_type: str = "string") -> DataFrame:
    """(class_key, node_id, iri, change, batch) of all committed batches."""
    deltas = _kept(spark, path, "deltas", f"class_key {class_type}, node_id string, iri string, change int, batch bigint")
    return deltas.join(_kept(spark, path, "held", HELD).select("batch").distinct(), "batch", "left_semi")


# Health ------------------------------------------------------------------------


def cycle_health(crawl_log: DataFrame, interval: str, delay: str) -> DataFrame:
    """Attempts, successes and failures per interval; rows later than `delay`
    are dropped."""
    window = F.window("finished_at", interval)
    return (
        crawl_log.withWatermark("finished_at", delay)
        .groupBy(window)
        .agg(
            F.count("*").alias("attempted"),
            F.count_if("ok").alias("succeeded"),
            F.count_if(~F.col("ok")).alias("failed"),
        )
        .select(F.unix_micros("window.start").alias("start"), "attempted", "succeeded", "failed")
    )


def open_intervals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What cycle_health holds of intervals it hasn't closed yet, from the state of
    its last batch: the same columns. With what it has emitted, all intervals."""
    held = spark.read.format("statestore").load(checkpoint)
    # the state names all counts alike, so they are told apart by position
    counts = F.col("value").cast("struct<attempted:bigint,succeeded:bigint,failed:bigint>").alias("counts")
    window = F.col("key").cast("struct<window:struct<start:timestamp,end:timestamp>>").getField("window")
    return held.select(F.unix_micros(window.getField("start")).alias("start"), counts).select("start", "counts.*")


class Expiry(StatefulProcessor):
    """Per node: the last success, and a timer for when it becomes too old."""

    def __init__(self, max_age_ms: int) -> None:
        self.max_age_ms = max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.success = handle.getValueState("success", "at BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(
            (int(part.loc[part.ok, "at_ms"].max()) for part in rows if part.ok.any()), default=None
        )
        held = self.success.get()[0] if self.success.exists() else None
        if newest is not None and (held is None or newest > held):
            if held is not None:
                self.handle.deleteTimer(held + self.max_age_ms + 1)
            self.success.update((newest,))
            self.handle.registerTimer(newest + self.max_age_ms + 1)
        yield pd.DataFrame({"node_id": [], "last_success_ms": []}).astype(
            {"node_id": "object", "last_success_ms": "int64"}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.success.get()[0] if self.success.exists() else None
        due = expiredTimerInfo.getExpiryTimeInMs()
        if held is not None and held + self.max_age_ms < due:
            self.success.clear()
            yield pd.DataFrame({"node_id": [key[0]], "last_success_ms": [held]})

    def close(self) -> None:
        pass


def expiries(crawl_log: DataFrame, max_age_secs: int, delay: str = "10 minutes") -> DataFrame:
    """(node_id, last_success_ms) whenever the watermark passes a node's age
    limit. Failed crawls neither refresh nor remove what is held."""
    return (
        crawl_log.withWatermark("finished_at", delay)
        .select("node_id", "ok", "finished_at", F.unix_millis("finished_at").alias("at_ms"))
        .groupBy("node_id")
        .transformWithStateInPandas(
            Expiry(max_age_secs * 1000),
            outputStructType="node_id STRING, last_success_ms BIGINT",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def live_status(crawl_log: DataFrame) -> DataFrame:
    """Newest attempt, success and error per participant, for update mode."""
    newest = F.max(F.struct("finished_at", "cycle_id", "ok", "error"))
    return crawl_log.groupBy("node_id").agg(
        newest.alias("newest"), F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_success")
    ).select(
        "node_id", F.col("newest.finished_at").alias("last_attempt"), "last_success",
        F.when(~F.col("newest.ok"), F.col("newest.error")).alias("last_error"),
    )


# Bounded runs ------------------------------------------------------------------


def event_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of crawl log rows."""
    events = spark.readStream.schema(
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ).parquet(f"{sf_dir}/events.parquet*")
    return events.selectExpr(
        "'nation-' || user_id % 25 AS node_id",
        "bigint(floor(unix_timestamp(timestamp(ts)) / 3600)) AS cycle_id",
        "timestamp(ts) AS finished_at",
        "event_type <> 'error' AS ok",
        "IF(event_type = 'error', 'crawl failed: ' || props, NULL) AS error",
    )


def run_to_table(
    stream: DataFrame, state: str | None = None, mode: str = "append", root: str | None = None
) -> DataFrame:
    """Drain what the stream's source holds into a table and read it. The table and
    the checkpoint lie in `root`, a folder of its own if none is given."""
    spark = stream.sparkSession
    root = root or f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if state == "rocksdb":
        spark.conf.set(key, ROCKSDB)
    try:
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/checkpoint"
        ).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
