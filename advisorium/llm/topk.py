"""Operator 2, exact top-k search with block-at-a-time pruning.

Components are terms. Documents lie in ranges with a forward index (their weights as a matrix) and, by block
of a range, the largest and smallest weight of each term. A query meets every range; in it, blocks are taken
in order of their summed term maxima and scored until the bound falls below the query's kth score. A first
pass of every query block over one range, dealt by a hash, gives that score a floor before any other range is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advisorium.llm.common import cut, table

RANGE, BLOCK, QUERIES = 8192, 256, 512
_SCHEMA = pa.schema([("part", pa.int64()), ("size", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("floors", pa.binary())])
_DDL = "part long, size int, n int, ids binary, weights binary, floors binary"


def arrange(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """An order that puts alike documents in one block: by the nearest of some pivots of the range."""
    pivots = weights[:: max(1, len(weights) // 32)].astype(float)
    near = (weights.astype(float) @ pivots.T - 0.5 * (pivots**2).sum(axis=1)).argmax(axis=1)
    return np.lexsort((ids, near))


def grouped(vectors: DataFrame, most: int, scale: float) -> DataFrame:
    """Vectors as blocks of at most most rows of one dimension: ids and scaled whole-number weights, packed.

    Blocks are filled as a task reads its rows, so no key can be too frequent, and are numbered by task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def block(size: int, rows: list) -> pa.RecordBatch:
            ids, weights = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), size)
            order = arrange(ids, weights) if size else np.arange(len(rows))
            return pa.RecordBatch.from_pylist([{"part": first + made, "size": size, "n": len(rows), "ids": ids[order].tobytes(), "weights": weights[order].tobytes(), "floors": None}], schema=_SCHEMA)

        for batch in batches:
            for vec_id, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if vec_id is None or vector is None or any(x is None for x in vector):
                    continue
                x = np.array(vector, float)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if len(x) * float(np.abs(x).max(initial=0)) ** 2 >= 2.0**62:
                    raise ValueError(f"vector {vec_id} has components whose scores pass 64 bits")
                held.setdefault(len(x), []).append((vec_id, x.astype(np.int64)))
                if len(held[len(x)]) == most:
                    yield block(len(x), held.pop(len(x)))
                    made += 1
        for size, rows in held.items():
            yield block(size, rows)
            made += 1

    return vectors.mapInArrow(run, _DDL)


def unpack(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[prefix + "ids"], np.int64)
    return ids, np.frombuffer(row[prefix + "weights"], np.int64).reshape(len(ids), row["size"])


def best_distinct(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best different ids by score and then id, each with its best score."""
    take = k
    while True:
        if take < len(scores):
            least = np.partition(scores, len(scores) - take)[len(scores) - take]
            at = np.flatnonzero(scores >= least)
        else:
            at = np.arange(len(scores))
        order = at[np.lexsort((ids[at], -scores[at]))]
        _, first = np.unique(ids[order], return_index=True)
        if len(first) >= k or len(at) == len(scores):
            order = order[np.sort(first)][:k]
            return ids[order], scores[order]
        take = len(at) * 2


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int, floors: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (by place) the ids and scores of its best k in one range that are not below its floor."""
    starts = np.arange(0, len(ids), BLOCK)
    # whole numbers under 2**53 are exact in doubles; larger ones stay 64-bit
    exact = np.float64 if float(np.abs(queries).max(initial=0)) * float(np.abs(weights).max(initial=0)) * max(1, queries.shape[1]) < 2**52 else np.int64
    queries, weights = queries.astype(exact), weights.astype(exact)
    if queries.shape[1]:
        most, least = np.maximum.reduceat(weights, starts), np.minimum.reduceat(weights, starts)
        bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    else:
        bounds = np.zeros((len(queries), len(starts)), exact)
    for q in range(len(queries)):
        found_ids, found = np.zeros(0, np.int64), np.zeros(0, exact)
        floor = floors[q] if floors is not None else -np.inf
        for b in np.argsort(-bounds[q], kind="stable"):
            if bounds[q, b] < floor:
                break
            own = slice(starts[b], starts[b] + BLOCK)
            scores = weights[own] @ queries[q]
            fit = (scores >= floor) & (ids[own] != query_ids[q])
            if fit.any():
                found_ids, found = best_distinct(np.concatenate((found_ids, ids[own][fit])), np.concatenate((found, scores[fit])), k)
                if len(found) == k:
                    floor = max(floor, found[-1])
        yield q, found_ids, found.astype(np.int64)


def top_k(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest whole-number inner products, ties to the smaller vec_id.

    is_query is a SQL condition on vec_id. A weight is floor(scale * component). Candidates are all vectors
    of the query's dimension with another id; fewer than k are all returned.

    Vectors that are null or hold null or non-finite components, and null ids, take no part. A repeated id
    is one candidate with its best score, and one query with the best scores of its rows. Components so large
    that scores pass 64 bits raise ValueError. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    ranges = cut(grouped(rows, RANGE, scale), "ranges")
    queries = cut(grouped(rows.where(is_query), QUERIES, scale), "queries")
    floors_schema = pa.schema([("q_part", pa.int64()), ("floors", pa.binary())])
    hits_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    # floors: every query block is scored against one range of its dimension, dealt by a hash of its number
    count = ranges.groupBy("size").agg(F.count("*").alias("ranges"))
    numbered = cut(ranges.select("size", "part").withColumn("i", F.row_number().over(Window.partitionBy("size").orderBy("part")) - 1), "numbers")
    blocks = queries.withColumnsRenamed({"part": "q_part", "ids": "q_ids", "weights": "q_weights", "n": "q_n"}).drop("floors").join(count, "size")
    dealt = blocks.withColumn("i", F.pmod(F.xxhash64("q_part"), F.col("ranges"))).join(numbered, ["size", "i"]).join(ranges.select("part", "ids", "weights"), "part")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (q_ids, q), (ids, w) = unpack(row, "q_"), unpack(row, "")
                floors = np.full(len(q_ids), -np.inf)
                for at, _, scores in search(q_ids, q, ids, w, k, None):
                    if len(scores) == k:
                        floors[at] = scores[-1]
                yield pa.RecordBatch.from_pylist([{"q_part": row["q_part"], "floors": floors.tobytes()}], schema=floors_schema)

    floors = cut(dealt.select("q_part", "size", "q_ids", "q_weights", "ids", "weights").mapInArrow(first, "q_part long, floors binary"), "floors")
    # the stated query set against all rows, block by range
    spread = blocks.join(floors, "q_part").withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("ranges") - 1).cast("int"))))
    pairs = spread.join(numbered, ["size", "i"]).join(ranges.select("part", "ids", "weights"), "part").select("size", "q_ids", "q_weights", "floors", "ids", "weights")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (q_ids, q), (ids, w) = unpack(row, "q_"), unpack(row, "")
                out: list[list[np.ndarray]] = [[], [], []]
                for at, found, scores in search(q_ids, q, ids, w, k, np.frombuffer(row["floors"])):
                    out[0].append(np.full(len(found), q_ids[at]))
                    out[1].append(found)
                    out[2].append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], schema=hits_schema)

    hits = pairs.mapInArrow(rest, "query_id long, vec_id long, score long")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for every hundredth."""
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id % 100 = 0")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.w, d.w)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
