"""Operator 6, secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models are counted from labelled samples of the corpus itself: the values that the base
patterns find are samples of random strings, all other long identifiers are samples of ordinary ones. A
long identifier outside the base spans is a secret too if its log-likelihood ratio is high. DataFrame
functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm.common import cut, table
from advisorium.llm.spans import Kind, joined, matches, with_touches

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The hex and access patterns ask for their least length at once: a shorter run has no match within it either.
KINDS = [
    Kind("assign", ASSIGN, 2),
    Kind("access", "AKIA[A-Z0-9]{14,}", only_if="AKIA"),
    Kind("hex", "[0-9a-f]{16,}"),
    Kind("markov", "[A-Za-z0-9+/_=-]{16,}"),
]
NAMES = [k.name for k in KINDS]
MARKOV = len(KINDS) - 1
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_ASSIGNED = 12


def log_ratios(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """For each pair of characters (row by row of the alphabet) the log of how much likelier the step is in random strings.

    A step's chance is its count, smoothed by weight times the chance of its second character. The weight is
    large for ordinary strings, so that an unlabelled secret among them doesn't make its own steps likely. At most len(ALPHABET) squared numbers come to the driver.
    """
    size = len(ALPHABET)

    def steps(samples: DataFrame) -> dict[str, int]:
        pairs = samples.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))).alias("pair"))
        return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}

    def chances(count: dict[str, int], weight: float) -> list[float]:
        single = {b: sum(count.get(a + b, 0) for a in ALPHABET) + 1 for b in ALPHABET}
        total = sum(single.values())
        before = {a: sum(count.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
        return [(count.get(a + b, 0) + weight * single[b] / total) / (before[a] + weight) for a in ALPHABET for b in ALPHABET]

    likely, plain = (chances(steps(x.where(F.length("value") > 1)), weight) for x, weight in ((random, 20.0), (ordinary, 200.0)))
    assert len(likely) == size * size
    return [math.log(x / y) for x, y in zip(likely, plain, strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string; characters outside the alphabet end the steps they are in."""
    weights, size = F.lit(model), len(ALPHABET)

    def step(s: Column, c: Column) -> Column:
        here = F.instr(F.lit(ALPHABET), c)
        known = (s["last"] > 0) & (here > 0)
        return F.struct(here.alias("last"), (s["sum"] + F.when(known, F.element_at(weights, F.greatest((s["last"] - 1) * size + here, F.lit(1)))).otherwise(0.0)).alias("sum"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), step)["sum"]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = 12.0) -> DataFrame:
    """One row per input row: row, doc_id, n_assign, n_access, n_hex, base (spans), spans (all); a span has kind, begin, finish, value.

    Spans are in code points, end exclusive, by start and then kind. A long identifier that touches no base
    span is one of kind markov if its log-likelihood ratio is at least least_ratio nats.

    A null or empty text has no spans; a corpus without samples of either sort adds none. Repeated rows and
    null ids are each returned, texts are read whole, other columns are not read, and an empty table gives
    no rows.
    """
    found = cut(matches(docs, KINDS, id_col, text_col), "matches")
    base = F.col("kind") < MARKOV
    good = ~base | (F.col("kind") != 0) | (F.length("value") >= LEAST_ASSIGNED)
    found = with_touches(found.where(F.col("kind").isNull() | good), base)
    span = F.struct("begin", "kind", "finish", "value")
    by_row = found.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(base, span))).alias("base"), F.collect_list(F.when((F.col("kind") == MARKOV) & ~F.col("touches"), span)).alias("other"))
    by_row = cut(by_row, "rows")
    sample = F.regexp_replace("value", r"[^A-Za-z0-9+/_=-]", "")
    random = by_row.select(F.explode("base.value").alias("value")).select(sample.alias("value"))
    ordinary = by_row.select(F.explode("other.value").alias("value"))
    model = log_ratios(random, ordinary)
    added = F.filter("other", lambda o: ratio(o["value"], model) >= least_ratio)
    number = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return by_row.select("row", "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), "base", F.array_sort(F.concat("base", added)).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, as counts and span texts."""
    found = secret_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base"), NAMES), 256).alias("base_sha256"), joined(F.col("spans"), NAMES).alias("spans"))
