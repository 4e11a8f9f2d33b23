"""A keyed store in buckets, and a run log: a batch rewrites only the buckets that its keys fall into.

Each batch writes its buckets, its changes and its log under its own number, then a manifest that names for every
bucket the batch that wrote it last. A batch counts once its manifest is there; a batch that failed before is
written over by its repetition, and one that has its manifest is not applied again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def newest_of(old: Column, new: Column) -> Column:
    """The greater of two rows: the merge of rows that start with their order."""
    return F.greatest(old, new)


class KeyedStore:
    """Rows of one key column in a folder that all executors share.

    schema is that of the rows, merge gives a key's row from its old and its new one, both not null, as structs
    of the other columns. Rows of one key in a batch are reduced to the greatest by those columns first; rows without
    a key are left out. Buckets are fixed when the store is made: choose them so that one fits a task. bucket may give
    another one than the key's hash, such as the day of rows whose key always has the same day, so that a batch of
    a few days touches only theirs.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64, merge: Callable[[Column, Column], Column] = newest_of, bucket: Column | None = None):
        self.spark, self.path, self.schema, self.key, self.buckets, self.merge = spark, path, schema, key, buckets, merge
        self.bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int") if bucket is None else bucket.cast("int")
        self.others = [c for c in schema.names if c != key]
        self.bucketed = T.StructType([T.StructField("store_bucket", T.IntegerType()), T.StructField("store_key", schema[key].dataType), T.StructField("store_row", T.StructType([schema[c] for c in self.others]))])

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def manifest(self) -> tuple[int, dict[int, int]]:
        """(last batch that counts, bucket -> batch that wrote it last); -1 and nothing for a new store."""
        if not self._exists(f"{self.path}/manifest"):
            return -1, {}
        rows = self.spark.read.schema("batch long, bucket int, written long").parquet(f"{self.path}/manifest/*")
        last = rows.agg(F.max("batch")).first()[0]
        if last is None:
            return -1, {}
        # one row per bucket
        return last, {r.bucket: r.written for r in rows.where(F.col("batch") == last).collect() if r.bucket is not None}

    def counted(self, batch: int) -> bool:
        return self._exists(f"{self.path}/manifest/{batch:012d}/_SUCCESS")

    def _buckets(self, of: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/written={written}/store_bucket={bucket}" for bucket, written in sorted(of.items())]
        if not paths:
            return self.spark.createDataFrame([], self.bucketed)
        return self.spark.read.schema(self.bucketed).option("basePath", f"{self.path}/rows").parquet(*paths).select(*self.bucketed.names)

    def read(self) -> DataFrame:
        """All rows as they are now, whatever is written later."""
        return self._buckets(self.manifest()[1]).select(F.col("store_key").alias(self.key), *[F.col("store_row").getField(c).alias(c) for c in self.others]).select(*self.schema.names)

    def changes(self) -> DataFrame:
        """key, before, after, batch of all batches that count."""
        last = self.manifest()[0]
        shape = T.StructType([T.StructField("store_key", self.schema[self.key].dataType), T.StructField("before", self.bucketed["store_row"].dataType), T.StructField("after", self.bucketed["store_row"].dataType), T.StructField("batch", T.LongType())])
        if last < 0:
            return self.spark.createDataFrame([], shape).withColumnRenamed("store_key", self.key)
        done = self.spark.read.schema("batch long, bucket int, written long").parquet(f"{self.path}/manifest/*").select(F.col("batch").alias("done")).distinct()
        found = self.spark.read.schema(shape).parquet(f"{self.path}/changes/*")
        return found.join(done, F.col("batch") == F.col("done"), "left_semi").withColumnRenamed("store_key", self.key)

    def log(self) -> DataFrame:
        """batch, level, source, message of all batches that count, each once."""
        last = self.manifest()[0]
        shape = "batch long, level string, source string, message string"
        if last < 0 or not self._exists(f"{self.path}/log"):
            return self.spark.createDataFrame([], shape)
        done = self.spark.read.schema("batch long, bucket int, written long").parquet(f"{self.path}/manifest/*").select(F.col("batch").alias("done")).distinct()
        return self.spark.read.schema(shape).parquet(f"{self.path}/log/*").join(done, F.col("batch") == F.col("done"), "left_semi")

    def apply(self, rows: DataFrame, batch: int, log: DataFrame | None = None) -> bool:
        """Merge a batch's rows, and append its log (level, source, message); False if the batch had been applied already."""
        if self.counted(batch):
            return False
        name = f"{batch:012d}"
        fresh = rows.where(F.col(self.key).isNotNull()).select(F.coalesce(self.bucket, F.lit(-1)).alias("f_bucket"), F.col(self.key).alias("f_key"), F.struct(*self.others).alias("f_row")).groupBy("f_bucket", "f_key").agg(F.max("f_row").alias("f_row"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/fresh/{name}")
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/fresh/{name}")
        touched = sorted(r[0] for r in fresh.select("f_bucket").distinct().collect())  # at most one row per bucket
        known = self.manifest()[1]
        old = self._buckets({b: known[b] for b in touched if b in known})
        both = old.join(fresh, (F.col("store_bucket") == F.col("f_bucket")) & (F.col("store_key") == F.col("f_key")), "full")
        row, new = F.col("store_row"), F.col("f_row")
        # a row of nulls alone is not a row that is absent: keys tell which
        merged = F.when(F.col("store_key").isNull(), new).when(F.col("f_key").isNull(), row).otherwise(self.merge(row, new))
        both = both.select(F.coalesce("store_bucket", "f_bucket").alias("store_bucket"), F.coalesce("store_key", "f_key").alias("store_key"), row.alias("before"), merged.alias("store_row"), F.col("store_key").isNull().alias("is_new"))
        changed = both.where("is_new or not (before <=> store_row)").select("store_key", "before", F.col("store_row").alias("after"), F.lit(batch).cast("long").alias("batch"))
        changed.write.mode("overwrite").parquet(f"{self.path}/changes/{name}")
        if touched:
            both.select("store_bucket", "store_key", "store_row").repartition(len(touched), "store_bucket").write.mode("overwrite").partitionBy("store_bucket").parquet(f"{self.path}/rows/written={batch}")
        if log is not None:
            log.select(F.lit(batch).cast("long").alias("batch"), "level", "source", "message").write.mode("overwrite").parquet(f"{self.path}/log/{name}")
        manifest = known | dict.fromkeys(touched, batch)
        lines = [(batch, b, w) for b, w in sorted(manifest.items())] or [(batch, None, None)]
        self.spark.createDataFrame(lines, "batch long, bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{name}")
        return True

    def feed(self, stream: DataFrame, checkpoint: str, log: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Apply all that a stream has now, batch by batch; log gives a batch's lines from its rows."""

        def put(batch: DataFrame, number: int) -> None:
            self.apply(batch, number, log(batch) if log else None)

        stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
