"""Upsert of a stream into a table by key, with a feed of what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(spark: SparkSession, path: str, key: str, order: list[str], value: str, state_dir: str, files: int = 4) -> tuple[DataFrame, DataFrame]:
    """The state (key, value) and the changes (key, before, after, batch) that files of a path leave, read in batches of a few files.

    A key's row of highest order counts; a late row of lower order changes nothing. Null keys are left out. Each batch reads the
    state of the batch before it and writes its own under its number, so a repeated batch replaces itself. state_dir must be shared.
    """
    base = f"{state_dir}/upsert-{uuid.uuid4().hex}"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    rows = source.where(F.col(key).isNotNull()).select(F.col(key).alias("u_key"), F.struct(*order, value).alias("u_row"))
    shape = rows.schema
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("u_key").agg(F.max("u_row").alias("u_new"))
        old = spark.read.schema(shape).parquet(f"{base}/state/{number - 1:012d}") if number else spark.createDataFrame([], shape)
        both = old.join(fresh, "u_key", "full")
        best = F.when(F.col("u_row").isNull() | (F.col("u_new") > F.col("u_row")), F.col("u_new")).otherwise(F.col("u_row"))
        both.select("u_key", best.alias("u_row")).write.mode("overwrite").parquet(f"{base}/state/{number:012d}")
        before, after = F.col(f"u_row.{value}"), best[value]
        changed = both.where(~before.eqNullSafe(after) | F.col("u_row").isNull()).select(F.col("u_key").alias(key), before.alias("before"), after.alias("after"))
        changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/changes/{number:012d}")
        done.append(number)

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    feed = spark.read.parquet(*[f"{base}/changes/{n:012d}" for n in sorted(set(done))])
    state = spark.read.schema(shape).parquet(f"{base}/state/{max(done):012d}")
    return state.select(F.col("u_key").alias(key), F.col(f"u_row.{value}").alias(value)), feed
