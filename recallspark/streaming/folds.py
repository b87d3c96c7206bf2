"""The same folds over streams: exactly-once effects by idempotent keys over messages that arrive at least once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from recallspark.operators import browse, ledgers, steward, storage

#: Deliveries that a message gets before it is a dead letter, and partitions of event tables by key.
DELIVERIES, BUCKETS = 3, 64
_SYNC = "array<struct<event_id:string,idempotency_hash:string,user_text:string>>"


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 32) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_arrivals(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once while its state is kept; rows later than `late` behind the newest are dropped by the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to an event table; the sink's log makes each batch take effect once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _overwrite(rows: DataFrame, path: str, *parts: str) -> None:
    """Writes the partitions that rows has, and leaves others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def refold(spark: SparkSession, events: DataFrame, fold: Callable[[DataFrame], DataFrame], key: str, table: str, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """After each micro-batch the state of the keys it touches is fold(their events); key is a column of both.

    Events and state lie in partitions by a hash of the key, so a batch reads and writes only the partitions of its keys. A batch's events
    lie under its number, so a replay overwrites its own, and replayed or late events fold to the same state.
    """

    def take(batch: DataFrame, number: int) -> None:
        _overwrite(batch.withColumn("_bucket", _bucket(key, buckets)).withColumn("_batch", F.lit(number)), table, "_batch", "_bucket")
        touched = [r["_bucket"] for r in batch.select(_bucket(key, buckets).alias("_bucket")).distinct().collect()]  # `buckets` numbers at most
        if touched:
            state = fold(spark.read.parquet(table).where(F.col("_bucket").isin(touched)).drop("_batch", "_bucket"))
            _overwrite(state.withColumn("_bucket", _bucket(key, buckets)), out, "_bucket")

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def turns_of(messages: DataFrame, space: str, layer: str) -> DataFrame:
    """messages (value) with their turn's fields and route: process, skip (another space's, or no turn), or dead with an error."""
    rows = storage.unwrapped(messages).select("*", "turn.*").withColumnRenamed("memory_space_id", "space_id")
    routed = steward.routed(rows, space, layer)
    route = F.when(F.col("error").isNotNull(), "dead").when(F.col("kind") != "conversation_turn", "skip").otherwise(F.col("route"))
    error = F.coalesce("error", F.when(route == "dead", F.lit("wrong layer or nobody")))
    return routed.withColumn("route", route).withColumn("error", error)


def synced_turns(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """The turns that device-sync batches bring, each once by event id and by idempotency hash; they then go the way of other turns."""
    rows = messages.select("seq", F.posexplode(F.from_json(payload, _SYNC)).alias("n", "e")).select(F.struct("seq", "n").alias("seq"), "e.*")
    return ledgers.first_deliveries(rows)


def consume(messages: DataFrame, process: Callable[[DataFrame], DataFrame], done: str, retry: str, dead: str, checkpoint: str, deliveries: int = DELIVERIES, audit: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Processes routed messages (message_id, route, error and others) batch by batch.

    process returns its rows with a boolean `failed`. What succeeds goes to `done`; what fails comes again with the next batch, and
    after `deliveries` attempts is a dead letter, as are messages routed there; others are skipped. All of it lies under the batch's number,
    so a batch that is replayed overwrites its own. audit sees each batch's outcome.
    """
    spark = messages.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.where("route = 'process'").withColumn("attempt", F.lit(0))
        if storage.exists(spark, f"{retry}/_batch={number - 1}"):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{retry}/_batch={number - 1}"))
        out = process(rows).withColumn("attempt", F.col("attempt") + 1).withColumn("error", F.when(F.col("failed"), F.coalesce("error", F.lit("failed"))).otherwise(F.col("error"))).persist()
        again = F.col("failed") & (F.col("attempt") < deliveries)
        keep = lambda df, path: df.select(*rows.columns).write.mode("overwrite").parquet(f"{path}/_batch={number}")
        keep(out.where("not failed"), done)
        keep(out.where(again), retry)
        keep(out.where(F.col("failed") & ~again).select(*rows.columns).unionByName(batch.where("route = 'dead'").withColumn("attempt", F.lit(0)).select(*rows.columns)), dead)
        if audit:
            audit(out, number)
        out.unpersist()

    return messages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consolidate(drawers: DataFrame, themes: str, now: Column, window_days: int = 30, least: int = 3, newest: int = 30) -> int:
    """One run of the theme job: groups of the last days that have no theme yet are appended to the table at `themes`; says how many. A second run adds none."""
    since = now - F.make_dt_interval(F.lit(window_days))
    groups = browse.theme_groups(drawers.where("wing not in ('Wing_Privacy', 'Wing_Theme')"), since, window_days, least, newest)
    return storage.append_verified(groups, themes, "theme_id", ["space_id"])


class Progress(StreamingQueryListener):
    """Keeps the last numbers of each query: rows of a batch, and what the stream observes (DataFrame.observe)."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.observed: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[p.name or str(p.id)] = self.rows.get(p.name or str(p.id), 0) + p.numInputRows
        for name, row in (p.observedMetrics or {}).items():
            self.observed[name] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(events: DataFrame, name: str, key: str) -> DataFrame:
    """events, with their number and that of null keys observed under a name."""
    return events.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("without_key"))
