"""Operator 12, vector codes by product quantisation with annular norm pruning.

Vectors of whole numbers are cut into parts, each with a codebook of its own. A part's nearest entry is looked
for among entries sorted by norm: by the triangle inequality an entry nearer than the best so far differs in
norm by at most that distance, so the two ends of the interval are found by binary search and only the
annulus between them is evaluated, ends included, in exact integers. Spark sums parts by entry in each round;
only codebooks and one sum per entry pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm.common import cut, table

#: Parts of a vector, entries of a codebook, and rounds of assigning and moving.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Whole-number components are held within this, so that squared distances stay exact in 64 bits.
REACH = 1 << 24
#: Rows of an error table by label up to which it is broadcast.
BROADCAST_LABELS = 200_000


class Book:
    """A part's codebook, its entries in order of norm."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.count = entries, len(entries)
        norms = np.sqrt((entries.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, squared distance, distances evaluated); of equal distances the lower index."""
        norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        distance, index = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        evaluated = 0

        def weigh(place: int, rows: np.ndarray) -> None:
            nonlocal evaluated
            evaluated += len(rows)
            entry = self.order[place]
            far = ((x[rows] - self.entries[entry]) ** 2).sum(axis=1)
            better = (far < distance[rows]) | ((far == distance[rows]) & (entry < index[rows]))
            rows = rows[better]
            distance[rows], index[rows] = far[better], entry

        # the entry next in norm gives the first bound
        first = np.minimum(np.searchsorted(self.norms, norms), self.count - 1)
        for place in np.unique(first).tolist():
            weigh(place, np.flatnonzero(first == place))
        # rounding of a square root is far below this
        reach = np.sqrt(distance.astype(float)) * (1 + 1e-9) + norms * 1e-9 + 1e-9
        low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        for step in range(1, self.count):  # outwards from the first, as far as the best distance still allows
            for place in (first - step, first + step):
                near = np.flatnonzero((place >= low) & (place < high))
                if not len(near):
                    continue
                bound = np.sqrt(distance[near].astype(float)) * (1 + 1e-9) + norms[near] * 1e-9 + 1e-9
                near = near[np.abs(self.norms[place[near]] - norms[near]) <= bound]
                evaluated += len(near)
                entry = self.order[place[near]]
                far = ((x[near] - self.entries[entry]) ** 2).sum(axis=1)
                better = (far < distance[near]) | ((far == distance[near]) & (entry < index[near]))
                distance[near[better]], index[near[better]] = far[better], entry[better]
            if not ((first - step >= low) | (first + step < high)).any():
                break
        return index, distance, evaluated


def whole(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of whole numbers."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256) -> DataFrame:
    """One row per vector that takes part: vec_id, code, error, label_error, codebooks_sha256.

    Null vectors and those that hold null or non-finite components take no part, nor do those whose length differs
    from that of the vector with the smallest id or isn't a positive multiple of parts. Components are
    floor(scale * x), held within REACH either way. Codebooks start from the vectors of the smallest ids (of equal
    ids the smaller vector first, those without an id last); with fewer vectors they are smaller. Repeated rows each
    count and are each returned, rows without a label share one label_error, other columns aren't read, and an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"), F.col(label_col).cast("string").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    number = lambda x: F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.floor(F.greatest(F.lit(-2.0 * REACH), F.least(F.lit(2.0 * REACH), x * scale))))).cast("int")
    able = rows.where(F.col("e").isNotNull()).where(F.forall("e", finite)).select("vec_id", "label", F.transform("e", number).alias("v"))
    smallest = able.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    dim = len(smallest[0].v) if smallest else 0
    empty = spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if not dim or dim % parts:
        return empty
    points = cut(able.where(F.size("v") == dim), "whole-vectors")
    if any(len(r.v) != dim for r in smallest):
        smallest = points.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    width = dim // parts
    books = np.array([r.v for r in smallest], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    summed = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            """Of a whole task: one row per entry in use and place."""
            known = [Book(b) for b in books]
            total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                x = whole(batch.column(0), dim).reshape(-1, parts, width)
                for p in range(parts):
                    index = known[p].nearest(x[:, p])[0]
                    np.add.at(total[p], index, x[:, p])
                    n[p] += np.bincount(index, minlength=books.shape[1])
            part, entry = np.nonzero(n)
            each = lambda v: pa.array(np.repeat(v, width))
            yield pa.RecordBatch.from_arrays([each(part.astype(np.int32)), each(entry.astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))), pa.array(total[part, entry].ravel()), each(n[part, entry])], schema=summed)

        moved = points.select("v").mapInArrow(sums, "part int, entry int, place int, total long, n long").groupBy("part", "entry", "place")
        new = books.copy()
        # one row per component of a codebook: its size, not the data's
        for r in moved.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            new[r.part, r.entry, r.place] = int(r.total) // r.n
        books = new

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Book(b) for b in books]
        for batch in batches:
            x = whole(batch.column(2), dim).reshape(-1, parts, width)
            found = [known[p].nearest(x[:, p]) for p in range(parts)]
            index = np.stack([f[0] for f in found], axis=1)
            error = np.sum([f[1] for f in found], axis=0)
            digits = max(2, len(f"{books.shape[1] - 1:x}"))
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], schema=coded)

    codes = cut(points.select("vec_id", "label", "v").mapInArrow(code, "vec_id long, label string, code string, error long"), "codes")
    by_label = cut(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    if by_label.count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_annular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return compressed(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def _round(number: int) -> str:
    """One round of assigning parts to the entries of book `number` and moving them."""
    return f"""
near{number} AS (SELECT p.vec_id, p.part, arg_min(b.entry, (list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT, b.entry)) AS entry,
    min(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT) AS far
  FROM parts p JOIN book{number} b ON b.part = p.part GROUP BY p.vec_id, p.part),
mean{number} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (
  SELECT n.part, n.entry, i, floor(sum(p.v[i])::DOUBLE / count(*))::BIGINT AS m FROM near{number} n JOIN parts p ON p.vec_id = n.vec_id AND p.part = n.part, (SELECT unnest(range(1, 5)) AS i) t
  WHERE i <= len(p.v) GROUP BY n.part, n.entry, i) GROUP BY part, entry),
book{number + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{number} b LEFT JOIN mean{number} m ON m.part = b.part AND m.entry = b.entry)"""


#: For vectors of 64 components, of distinct ids, as the driver's are.
SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM kept, (SELECT unnest(range(16)) AS part) t),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
book0 AS (SELECT part, entry, v FROM parts JOIN first USING (vec_id)),{_round(0)},{_round(1)},{_round(2)},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest
"""
