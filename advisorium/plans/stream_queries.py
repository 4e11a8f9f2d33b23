"""Queries over streamed state: health of sources with timers, and stores in buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.plans.registry import query
from advisorium.plans.text_queries import _state_dir
from advisorium.sources.tables import table
from advisorium.streaming import runs, source_health
from advisorium.streaming.store import KeyedStore


def results(events: DataFrame) -> DataFrame:
    """Events as collection results: errors of three kinds, views that found nothing, all others that found something."""
    k = F.col("event_id") % 3
    error = F.when(F.col("event_type") == "error", F.when(k == 0, "timeout").when(k == 1, "parse_error").otherwise("unreachable"))
    detected = F.when(F.col("event_type") == "view", 0).otherwise(1)
    return events.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), source_health.result_status(detected, error).alias("status"), error.alias("error"))


RESULTS_SQL = """r AS (SELECT user_id::VARCHAR AS source, event_id AS id, ts, CASE WHEN event_type = 'error' THEN ['timeout', 'parse_error', 'failed'][event_id % 3 + 1] WHEN event_type = 'view' THEN 'empty' ELSE 'success' END AS status,
    CASE WHEN event_type = 'error' THEN ['timeout', 'parse_error', 'unreachable'][event_id % 3 + 1] END AS error FROM events),
m AS (SELECT *, max((ts, id)) FILTER (status IN ('success', 'empty')) OVER w AS good, max((ts, id)) FILTER (status = 'success') OVER w AS found FROM r WINDOW w AS (PARTITION BY source)),
h AS (SELECT source, arg_max(status, (ts, id)) AS status, count(*) FILTER (error IS NOT NULL AND (good IS NULL OR (ts, id) > good)) AS retry_count, count(*) FILTER (status = 'empty' AND (found IS NULL OR (ts, id) > found)) AS empty_streak,
    max(ts) AS last_attempt, max(ts) FILTER (status IN ('success', 'empty')) AS last_good, arg_max(coalesce(error, ''), (ts, id)) AS last_error FROM m GROUP BY source),
a AS (SELECT *, last_good IS NULL OR epoch_ms(last_good) + 24 * 3600000 + 1 <= (SELECT epoch_ms(max(ts)) FROM events) AS stale FROM h)"""


def _health(spark: SparkSession, d: str) -> DataFrame:
    return source_health.last_states(runs.drained(spark, f"{d}/events.parque[t]", lambda e: source_health.source_health(results(e)), "update", _state_dir(spark)))


@query("stream_source_health", f"WITH {RESULTS_SQL} SELECT source, status, retry_count, empty_streak, (last_attempt::VARCHAR)[:19] AS last_attempt, (last_good::VARCHAR)[:19] AS last_good, nullif(last_error, '') AS last_error FROM a")
def stream_source_health(spark: SparkSession, d: str) -> DataFrame:
    """ST08: status, retries, empty streak and last good result of each source, by streamed state."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _health(spark, d).select("source", "status", "retry_count", "empty_streak", at("last_attempt"), at("last_good"), "last_error")


@query("stream_health_alerts", f"""WITH {RESULTS_SQL}
SELECT k || ':' || source AS alert_key, level FROM a, (VALUES ('stale', 'critical'), ('retries', 'warning'), ('empty', 'info')) t(k, level)
WHERE CASE k WHEN 'stale' THEN stale WHEN 'retries' THEN retry_count >= 3 ELSE empty_streak >= 5 END""")
def stream_health_alerts(spark: SparkSession, d: str) -> DataFrame:
    """ST13: open alerts of sources: stale by a timer, failures in a row, empty results in a row."""
    level = F.create_map(*[F.lit(x) for pair in source_health.LEVELS.items() for x in pair])
    return _health(spark, d).select("source", F.explode("alerts").alias("k")).select(F.concat_ws(":", "k", "source").alias("alert_key"), level[F.col("k")].alias("level"))


@query("stream_delay_alert", """
WITH r AS (SELECT ts, date_trunc('hour', ts) AS due FROM events WHERE event_type = 'signup'), n AS (SELECT arg_max(epoch_us(ts) - epoch_us(due), (due, ts)) AS late FROM r)
SELECT 'scheduler:delay' AS alert_key, 'warning' AS level, (late // 60000000)::BIGINT AS delay_minutes, late // 1000000 > 900 AS active FROM n""")
def stream_delay_alert(spark: SparkSession, d: str) -> DataFrame:
    """ST13: the alert of a planned run that started late, from runs that are due every hour."""
    found = runs.drained(spark, f"{d}/events.parque[t]", lambda e: source_health.delay_alerts(e.where("event_type = 'signup'").select("ts", F.date_trunc("hour", "ts").alias("due"))), "complete", _state_dir(spark))
    return found


def kept_longest(old: Column, new: Column) -> Column:
    """The newer row, but the text of the older one where that is longer."""
    first, last = F.least(old, new), F.greatest(old, new)
    text = F.when(F.length(first["text"]) > F.length(last["text"]), first["text"]).otherwise(last["text"])
    return F.struct(last["turn"].alias("turn"), text.alias("text"))


def _store(spark: SparkSession, d: str) -> KeyedStore:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    store = KeyedStore(spark, f"{_state_dir(spark)}/store-{uuid.uuid4().hex}", turns.schema, "conv_id", 16, kept_longest)
    line = lambda rows, level: rows.select(F.lit(level).alias("level"), F.col("conv_id").cast("string").alias("source"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("message"))
    for number, (even, level) in enumerate([(True, "info"), (False, "warning"), (False, "error")]):
        rows = turns.where((F.col("turn") % 2 == 0) == F.lit(even))
        store.apply(rows, min(number, 1), line(rows, level))  # the last is a repetition of the second
    return store


@query("store_rows", """
WITH t AS (SELECT conv_id, arg_max(turn, (turn, text)) AS turn, arg_max(text, (turn, text)) AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id, turn % 2),
b AS (SELECT conv_id, min((turn, text)) AS lo, max((turn, text)) AS hi FROM t GROUP BY conv_id)
SELECT conv_id, hi[1] AS turn, CASE WHEN length(lo[2]) > length(hi[2]) THEN lo[2] ELSE hi[2] END AS text FROM b""")
def store_rows(spark: SparkSession, d: str) -> DataFrame:
    """ST07: conversations by upsert into a store in buckets, in two batches of which one is repeated."""
    return _store(spark, d).read()


@query("store_changes", """
WITH t AS (SELECT conv_id, turn % 2 AS batch, max((turn, text)) AS r FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id, turn % 2), b AS (SELECT conv_id, r AS before FROM t WHERE batch = 0),
m AS (SELECT conv_id, before, greatest(before, r)[1] AS turn, CASE WHEN length(least(before, r)[2]) > length(greatest(before, r)[2]) THEN least(before, r)[2] ELSE greatest(before, r)[2] END AS after FROM t JOIN b USING (conv_id) WHERE batch = 1)
SELECT conv_id, 0::BIGINT AS batch, NULL::VARCHAR AS before, r[2] AS after FROM t WHERE batch = 0
UNION ALL SELECT conv_id, 1, NULL, r[2] FROM t WHERE batch = 1 AND conv_id NOT IN (SELECT conv_id FROM b)
UNION ALL SELECT conv_id, 1, before[2], after FROM m WHERE turn <> before[1] OR after <> before[2]""")
def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """ST07: the change feed of the same store."""
    return _store(spark, d).changes().select("conv_id", "batch", F.col("before.text").alias("before"), F.col("after.text").alias("after"))


@query("store_log", "SELECT turn % 2 AS batch, CASE turn % 2 WHEN 0 THEN 'info' ELSE 'warning' END AS level, count(*) AS n FROM conversations GROUP BY ALL")
def store_log(spark: SparkSession, d: str) -> DataFrame:
    """The run log of the same store; a repeated batch's lines are not appended again."""
    return _store(spark, d).log().groupBy("batch", "level").agg(F.count("*").alias("n"))


@query("overlap_rescan", """
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' AND event_id % 5 <> 0 THEN 0 ELSE 1 END AS batch FROM events
WHERE (ts < TIMESTAMP '2024-01-10' AND event_id % 5 <> 0) OR ts >= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-10' AND event_id % 5 <> 0) - INTERVAL 3 DAY""")
def overlap_rescan(spark: SparkSession, d: str) -> DataFrame:
    """ST02: two runs over a source; the second reads three days before the newest time and adds what came late."""
    events = table(spark, d, "events").where("ts is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    store = KeyedStore(spark, f"{_state_dir(spark)}/rescan-{uuid.uuid4().hex}", events.schema, "event_id", bucket=F.unix_date(F.to_date("ts")))
    first = runs.rescanned(store, events.where("ts < '2024-01-10' and event_id % 5 <> 0"), "ts", 0)
    second = runs.rescanned(store, events, "ts", 1)
    return first.select("event_id", F.lit(0).alias("batch")).unionAll(second.select("event_id", F.lit(1).alias("batch")))
