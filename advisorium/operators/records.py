"""Filters, merges, joins and windows over vulnerability records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dimension is broadcast only up to this many counted rows; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, hinted for broadcast if it has at most so many rows; the count stops one row past the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def not_rejected(records: DataFrame) -> DataFrame:
    """Without revoked records; a missing status counts as not revoked."""
    return records.where(~F.col("cve_status").eqNullSafe("rejected"))


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def on_day(column: str, day: str) -> Column:
    """In the half-open day."""
    return (F.col(column) >= ts(day)) & (F.col(column) < ts(day) + F.expr("INTERVAL 1 DAY"))


def recent(now: str, days: int) -> Column:
    """Published or collected within so many days before now."""
    start = ts(now) - F.expr(f"INTERVAL {days} DAYS")
    return (F.col("published_at") >= start) | (F.col("collected_at") >= start)


def period(start: str | None, end: str | None) -> Column:
    """Published or collected in the closed period, whose last day counts whole; an open bound is None."""
    if start and end and start > end:
        raise ValueError("the period ends before it starts")
    inside = lambda c: (F.lit(True) if not start else F.col(c) >= ts(start)) & (F.lit(True) if not end else F.col(c) < ts(end) + F.expr("INTERVAL 1 DAY"))
    return inside("published_at") | inside("collected_at")


def watch(records: DataFrame, known: DataFrame, start: str, end: str) -> DataFrame:
    """Records that are known, or published in [start, end); what was kept is told by column why."""
    seen = known.select("cve_id").distinct().withColumn("k", F.lit(True))
    fresh = (F.col("published_at") >= ts(start)) & (F.col("published_at") < ts(end))
    marked = records.join(seen, "cve_id", "left").withColumn("why", F.when(F.col("k"), "known").when(fresh, "published"))
    return marked.where("why is not null").drop("k")


def first_filled(column: str) -> Column:
    """The first value in order of arrival that is neither null nor empty."""
    return F.expr(f"min_by({column}, seq) FILTER (WHERE {column} IS NOT NULL AND cast({column} AS string) <> '')").alias(column)


def dedup_merge(records: DataFrame) -> DataFrame:
    """One record an id: scalars by first filled value, earliest publication, sources as the sorted set of their ids."""
    return records.where("cve_id is not null").groupBy("cve_id").agg(
        *[first_filled(c) for c in ("vendor", "product", "domain", "solution", "cve_status")], F.max("cvss_score").alias("cvss_score"),
        F.min("published_at").alias("published_at"), F.min("collected_at").alias("collected_at"), F.max("is_new").alias("is_new"),
        F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.count("*").alias("sightings"),
    )


def priority_merge(records: DataFrame, rank: Column) -> DataFrame:
    """Scalars from the source of the lowest rank that has a value; of equal ranks, the first to arrive."""
    ranked = records.withColumn("order_key", F.struct(rank.alias("r"), F.col("seq")))
    pick = lambda c: F.expr(f"min_by({c}, order_key) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    return ranked.groupBy("cve_id").agg(*[pick(c) for c in ("vendor", "product", "solution")])


def field_changes(stored: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key the status (new, removed, updated, unchanged) and the names of changed fields, joined by commas."""
    old = stored.select(key, F.lit(True).alias("had"), *[F.col(f).alias(f"old_{f}") for f in fields])
    both = new.select(key, F.lit(True).alias("has"), *fields).join(old, key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    status = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "removed").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    return both.select(key, status.alias("status"), F.when(status == "updated", F.array_join(changed, ",")).otherwise("").alias("changes"))


def top_per_group(records: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first most rows of each group, with their rank."""
    return records.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)


def failure_streaks(events: DataFrame, key: str, ts_col: str, tie: str, failed: Column) -> DataFrame:
    """Each key's longest and last run of failures without a success between."""
    order = Window.partitionBy(key).orderBy(ts_col, tie)
    islands = events.withColumn("failed", failed).withColumn("island", F.sum(F.when(failed, 0).otherwise(1)).over(order))
    runs = islands.groupBy(key, "island").agg(F.count(F.when(F.col("failed"), 1)).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "island").alias("last"))


def corroborated(records: DataFrame) -> DataFrame:
    """Ids that more than one source reports, with the number of sources."""
    return records.groupBy("cve_id").agg(F.countDistinct("source_id").alias("n_sources")).where("n_sources > 1")


def contamination(records: DataFrame, fields: list[str], least: int, tasks: int | None = None) -> DataFrame:
    """Values of a field that at least so many ids share exactly: field, value, n.

    Nearly every id and value is a pair of its own, so with tasks the pairs are dealt by id over so many and told apart there.
    """
    pairs = records.select("cve_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("p")).select("cve_id", "p.*")
    pairs = pairs.where("cve_id is not null and value is not null")
    if tasks:
        pairs = pairs.repartition(tasks, "cve_id")
    return pairs.distinct().groupBy("field", "value").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def as_of(records: DataFrame, runs: DataFrame, at: str, key: str, run_at: str) -> DataFrame:
    """Each record with the last run of its key at or before it, as one union and a running last value: no range join."""
    left = records.withColumn("a_at", F.col(at)).withColumn("a_run", F.lit(None).cast("timestamp_ntz")).withColumn("a_side", F.lit(1))
    right = runs.select(key, F.col(run_at).alias("a_at"), F.col(run_at).alias("a_run"), F.lit(0).alias("a_side"))
    order = Window.partitionBy(key).orderBy("a_at", "a_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("last_run", F.last("a_run", ignorenulls=True).over(order))
    return both.where("a_side = 1").drop("a_at", "a_run", "a_side")


def budgeted_prefix(texts: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Each group's texts in order while their running length stays within the budget."""
    run = F.sum(F.length(text)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return texts.withColumn("running", run).where(F.col("running") <= budget)


def host_suffix_match(hosts: DataFrame, domains: DataFrame, labels: int = 6) -> DataFrame:
    """hosts (host) with the longest domain that they equal or lie under: suffixes are exploded into an equi-join."""
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, labels + 1)]))
    spread = hosts.select("host", F.explode(suffixes).alias("domain"))
    met = spread.join(small(domains.select("domain", "org")), "domain")
    return met.groupBy("host").agg(F.max_by("org", F.length("domain")).alias("org"), F.max_by("domain", F.length("domain")).alias("domain"))


def alias_match(records: DataFrame, products: DataFrame, text: str) -> DataFrame:
    """Records and the products whose whole name stands in the text between other characters than a-z and 0-9.

    Distinct words of a text meet the names that begin with them by an equi-join; the whole name is then looked for in
    the text's words. So no pair is tried without a common word, and a text costs its length. Names without a word match nothing.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    names = products.select("name", words("name").alias("a_name")).where(F.size("a_name") > 0).distinct()
    names = names.select("name", F.element_at("a_name", 1).alias("a_first"), padded("a_name").alias("a_gram"))
    rows = records.withColumn("a_words", words(text)).withColumn("a_text", padded("a_words"))
    met = rows.withColumn("a_first", F.explode(F.array_distinct("a_words"))).join(small(names), "a_first").where(F.contains("a_text", F.col("a_gram")))
    return met.select(*records.columns, "name")
