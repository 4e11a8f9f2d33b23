"""Operator 4, quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled one and a scaled identity. A score is the
logistic of the difference of the classes' log densities, from Mahalanobis distances by Cholesky factors
that are made once and reused for every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm.common import bounded_batches, cut, portions, table, text_crc

FEATURES = (
    "characters", "words", "word_length", "distinct_words", "repeated_neighbours", "letters", "capitals", "digits", "spaces", "sentence_marks",
    "other_marks", "marked_words", "most_frequent_word", "line_length", "distinct_lines", "bar_words",
)
_WORD_END = re.compile(r"[^\w\s]{3,}(?:\s|$)")


def statistics(text: str) -> list[float]:
    """The document statistics, each transformed (logs of counts, logs or roots of shares) to be nearly normal."""
    n = max(len(text), 1)
    words = text.split()
    w = max(len(words), 1)
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    small = np.bincount(np.minimum(raw, 128), minlength=129)
    letters = small[65:91].sum() + small[97:123].sum() + small[128]
    marks = small[33:48].sum() + small[58:65].sum() + small[91:97].sum() + small[123:127].sum()
    ends = small[[33, 44, 46, 63]].sum()
    lines = [x for x in text.split("\n") if x.strip()]
    root = lambda x: float(np.sqrt(max(x, 0.0)))
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(np.log(sum(map(len, words)) / w + 0.5)), float(np.log(len(counts) / w + 0.02)),
        root(sum(a == b for a, b in zip(words, words[1:], strict=False)) / w), root(letters / n), root(small[65:91].sum() / n), root(small[48:58].sum() / n),
        root((small[32] + small[9] + small[10]) / n), root(ends / n), root((marks - ends) / n), root(len(_WORD_END.findall(text)) / w),
        float(np.log(max(counts.values(), default=1) / w + 0.02)), float(np.log(w / max(len(lines), 1) + 0.5)), float(np.log(len(set(lines)) / max(len(lines), 1) + 0.05)), root(counts.get("|", 0) / w),
    ]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and x, the statistics of the whole text; a null text is read as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t or "") for t in batch.column(1).to_pylist()], schema.types[1])], schema=schema)

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Discriminant(NamedTuple):
    """Per class (0, 1) the mean, the inverse Cholesky factor and the log determinant and prior."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 2, -500, 500)))


def fit(samples: DataFrame, to_pooled: float = 0.2, to_identity: float = 0.02) -> Discriminant | None:
    """The discriminant from rows (x, label), by moments summed on the executors; None unless both labels are there.

    A class covariance is (1 - to_pooled) of its own and to_pooled of the pooled one, then moved by
    to_identity towards the mean variance.
    """
    k = len(FEATURES)
    ddl = "label int, n long, " + "s array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {y: np.zeros(k + k * k + 1) for y in (0, 1)}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, k)
            y = np.array(batch.column(1).to_pylist())
            for label in (0, 1):
                own = x[y == label]
                sums[label] += np.concatenate((own.sum(axis=0), (own.T @ own).ravel(), [len(own)]))
        yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "n": pa.array([int(v[-1]) for v in sums.values()], pa.int64()), "s": pa.array([v[:-1] for v in sums.values()], pa.list_(pa.float64()))})

    # a few hundred sums a label and task, added up by place
    parts = samples.select("x", F.col("label").cast("int").alias("label")).where("label in (0, 1)").mapInArrow(run, ddl)
    summed = parts.select("label", "n", F.posexplode("s").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    count, sums = np.zeros(2), np.zeros((2, k + k * k))
    for r in summed:
        count[r["label"]], sums[r["label"], r["i"]] = r["n"], r["v"]
    if min(count) < 1:
        return None
    means = sums[:, :k] / count[:, None]
    own = np.array([sums[c, k:].reshape(k, k) / count[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = np.einsum("c,cij->ij", count / count.sum(), own)
    factors, offsets = [], []
    for c in (0, 1):
        shrunk = (1 - to_pooled) * own[c] + to_pooled * pooled
        shrunk = (1 - to_identity) * shrunk + to_identity * np.diag(np.diag(pooled) + 1e-6)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(count[c] / count.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score (higher: label 1 is likelier), predicted (1 from threshold on).

    Labels are learnt from rows whose crc32(doc_id as text) mod folds is not 0; rows of remainder 0 are held
    out. Null, empty and very long texts have statistics like any other. Labels other than 0 and 1 (and
    null) are left out; without both labels to learn from, all scores are 0.5. A null id has the fold of
    its own (held_out false) and is never learnt from. Repeated rows are each returned, and each counted
    when they carry a label; ids labelled both ways count once for each. Other columns are not read; an
    empty table gives no rows.
    """
    seen = cut(with_statistics(docs, id_col, text_col), "statistics")
    held = F.coalesce(text_crc("doc_id") % folds == 0, F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").distinct()
    model = fit(seen.where(~held).join(marks, F.col("doc_id") == F.col("l_id")).select("x", "label"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5), pa.float64())], schema=schema)

    scored = seen.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
