"""Incremental state over a stream of runs: deduplication, windows, and each source's state by upsert."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.streaming.store import KeyedStore


def drained(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], mode: str, state_dir: str, files: int = 4) -> DataFrame:
    """What a streaming plan over the files of a path (a folder, or a pattern for one file) gives once all are read, in batches of a few files.

    Output and checkpoint lie in state_dir, which all executors must share; each batch's rows are written under
    its number, so a repeated batch replaces itself.
    """
    name = uuid.uuid4().hex
    out, kept = f"{state_dir}/stream-{name}", f"{state_dir}/stream-{name}-checkpoint"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    result = plan(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:012d}")

    result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(result.schema.add("batch", "string")).parquet(out)
    if mode == "complete":
        last = written.agg(F.max("batch").alias("last_batch"))
        written = written.join(F.broadcast(last), F.col("batch") == F.col("last_batch")).drop("last_batch")
    return written.drop("batch")


def deduplicated(spark: SparkSession, path: str, key: str, ts_col: str, state_dir: str, files: int = 4) -> KeyedStore:
    """Each key once, however late, repeated or unordered the files of a path bring it: a store in buckets by day of event time.

    A key's rows must agree on their time; of rows that differ elsewhere the greatest counts. Only the days that a
    batch's rows fall into are read and written. Rows without a key are left out, rows without a time share a bucket.
    """
    schema = spark.read.parquet(path).schema
    store = KeyedStore(spark, f"{state_dir}/seen-{uuid.uuid4().hex}", schema, key, bucket=F.unix_date(F.to_date(ts_col)))
    store.feed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path), f"{store.path}/checkpoint")
    return store


def rescanned(store: KeyedStore, source: DataFrame, ts_col: str, batch: int, overlap: str = "3 days") -> DataFrame:
    """Rows of a source that a run adds to a store: those from overlap before the store's newest time on, not met before.

    The bound is one value, so that it reaches the source's scan. A row that turns up later than overlap after its
    time is left to a run with a longer one. The rows are returned as the store's changes of this batch.
    """
    mark = store.read().agg(F.max(ts_col)).first()[0]
    fresh = source if mark is None else source.where(F.col(ts_col) >= F.lit(mark) - F.expr(f"INTERVAL {overlap}"))
    store.apply(fresh, batch)
    return store.changes().where((F.col("batch") == batch) & F.col("before").isNull()).select(store.key, "after.*")


def tumbling(events: DataFrame, ts_col: str, width: str, group: str) -> DataFrame:
    """Counts by window and group."""
    counted = events.groupBy(F.window(ts_col, width), group).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), group, "n")


def source_state(events: DataFrame) -> DataFrame:
    """By source: runs, failures, last attempt and last success."""
    failed = F.col("event_type") == "error"
    return events.groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if(failed).alias("failures"), F.max("ts").alias("last_attempt"), F.max(F.when(~failed, F.col("ts"))).alias("last_success"))


def alerts(state: DataFrame, share: float) -> DataFrame:
    """Sources whose share of failed runs is over a bound: an active alert each."""
    return state.where(F.col("failures") > share * F.col("runs")).select(F.concat(F.lit("failing:"), F.col("user_id").cast("string")).alias("alert_key"), "runs", "failures")
