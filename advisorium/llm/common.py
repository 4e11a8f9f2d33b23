"""What the operators of this subpackage share: table reads, lineage cuts in the shared folder, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that a Python worker is sent at most, but for single rows that are larger.
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def bounded_batches(docs: DataFrame) -> DataFrame:
    """docs, after its session is told to send texts to Python workers in batches of few bytes, not of many rows.

    The setting stays in the session, as a plan is run after its operator has returned.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/advisorium-shared"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, so a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/advisorium/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids up to this many are broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in rejected's column id; rows with a null id stay.

    The ids are counted first: up to BROADCAST_IDS of them are broadcast, more are met by shuffle.
    """
    ids = cut(rejected.select(F.col("id").alias("r_id")).where("r_id is not null").distinct(), "rejected")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["r_id"], "left_anti")


def only(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with an id in wanted's column id; counted and broadcast, or met by shuffle, as in without()."""
    ids = cut(wanted.select(F.col("id").alias("w_id")).where("w_id is not null").distinct(), "wanted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["w_id"], "left_semi")


def portions(batch: pa.RecordBatch, text_column: int, at_once: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about at_once text bytes, so that a worker's memory doesn't follow the batch's size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= at_once or i == len(sizes) - 1:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0


def lower_ascii(c: Column | str) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_crc(c: Column | str) -> Column:
    """crc32 of an id written as text: the fold key."""
    return F.crc32(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Components of an undirected graph of long ids: (node, component), component being the smallest id reachable.

    Alternates large-star and small-star steps until the edges stay the same. Every step is a minimum by
    node and a join back, so no node's neighbours are ever gathered; each step is cut to the shared folder.
    Nodes without an edge are not returned; null ends and self-links are left out. An empty input gives no rows.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    pairs = cut(pairs, "cc")
    before = None
    for _ in range(rounds):
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(pairs.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        # small star: every node's smaller neighbours, and the node itself, hang on the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("k"), "m")
        small = (
            large.join(low, F.col("hi") == F.col("k"))
            .select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi")))).alias("e"))
            .select("e.*").where("lo < hi").distinct()
        )
        pairs = cut(small, "cc")
        now = pairs.agg(F.count("*"), F.sum(F.hash("lo", "hi").cast("long")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
