"""Queries over bodies of sources: JSON of any shape, pages in two levels, and streamed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.functions import matching, text, urls
from advisorium.functions.columns import spread
from advisorium.operators import json_objects
from advisorium.plans.registry import query
from advisorium.plans.text_queries import _state_dir
from advisorium.sources.tables import table, tasks_for
from advisorium.streaming import runs, upserts


@query("json_records", """
SELECT event_id, 'CVE-2024-' || (10000 + event_id) AS cve_id, 'Flaw ' || user_id AS title, 'in English ' || user_id AS description, 'high' AS severity, user_id::VARCHAR AS score, ['https://a/' || event_id, 'https://b'] AS refs, ['CWE-79'] AS weaknesses FROM events WHERE user_id % 4 <> 3
UNION ALL SELECT event_id, 'CVE-2024-' || (20000 + event_id), NULL, 'short', NULL, NULL, [], [] FROM events WHERE user_id % 4 <> 3""")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the longest list of objects with ids in nested JSON; a broken text gives none."""
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    body = F.concat(
        F.lit('{"meta": {"name": "list", "ids": [{"x": "CVE-1999-0001"}, 5]}, "data": {"items": [{"cve": {"ID": "cve-2024-'), (10000 + event).cast("string"), F.lit('", "more": {"severity": "high"}}, "Title": "Flaw '), user,
        F.lit('", "metrics": {"v": [{"baseScore": '), user, F.lit('}]}, "weak": "CWE-79 or CWE-79", "descriptions": [{"lang": "fr", "value": "en français"}, {"lang": "en", "value": "in English '), user,
        F.lit('"}], "references": [{"url": "https://a/'), event.cast("string"), F.lit('"}, "ftp://c", "https://b", "https://b"]}, {"id": "CVE-2024-'), (20000 + event).cast("string"), F.lit('", "summary": "short"}, {"id": "none"}]}'),
        F.when(F.col("user_id") % 4 == 3, "").otherwise("}"),
    )
    # some 40 s of work a task, so that the last ones keep no core waiting for long
    events = spread(table(spark, d, "events"), "event_id", least=tasks_for(spark, d, "events", 100_000))
    found = json_objects.json_records(events.select(event.alias("doc"), body.alias("body")))
    return found.select(F.col("doc").alias("event_id"), "cve_id", "title", "description", "severity", "score", "refs", "weaknesses")


@query("two_level_ids", """
WITH p AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)
SELECT url, CASE WHEN page_id % 2 = 0 THEN ['CVE-2020-1001', 'CVE-2020-1002', 'CVE-2020-1003'] ELSE ['CVE-2024-' || (10000 + page_id)] END AS ids FROM p""")
def two_level_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of listings, or of the pages that they link to where they show fewer than three."""
    first = table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    detail = F.concat("url", F.lit("#detail"))
    shown = F.when(F.col("page_id") % 2 == 0, "<p>cve-2020-1001, CVE-2020-1002 and CVE-2020-1003</p>").otherwise("")
    listing = first.select("url", F.concat("html", shown, F.lit('<a href="'), detail, F.lit('">more</a>')).alias("html"))
    details = first.select(detail.alias("url"), F.concat(F.lit("<p>CVE-2024-"), (10000 + F.col("page_id")).cast("string")).alias("html"))
    pages = listing.unionByName(details).select("url", text.cve_ids(F.col("html")).alias("ids"), F.filter(urls.links(F.col("html")), lambda x: x.startswith("http")).alias("links"))
    return json_objects.two_levels(pages, "ids", "links").where(~F.col("url").endswith("#detail"))


@query("stream_upsert", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """ST07: each source's last event by upsert of a stream into a table."""
    return upserts.upserted(spark, f"{d}/events.parque[t]", "user_id", ["ts", "event_id"], "event_type", _state_dir(spark))[0]


@query("stream_high_water", "SELECT user_id, (max(ts)::VARCHAR)[:19] AS mark FROM events WHERE event_type <> 'error' GROUP BY user_id")
def stream_high_water(spark: SparkSession, d: str) -> DataFrame:
    """ST01: each source's high-water mark, which advances only with runs that succeeded."""
    found = runs.drained(spark, f"{d}/events.parque[t]", runs.source_state, "complete", _state_dir(spark))
    return found.where("last_success is not null").select("user_id", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("mark"))


@query("question_scopes", "SELECT n_nationkey AS id, ['internal', 'external', 'internal', 'internal', 'auto', 'internal', 'auto'][n_nationkey % 7 + 1] AS scope FROM nation")
def question_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Q02: whether questions ask for the collection, for common knowledge, or for either."""
    said = ["Explain {}", "Qu'est-ce que le catalogue KEV de {} ?", "What is new cette semaine in {}?", "vulnérabilités de {}", "How to patch {}?", "Définition of {}, for a vendor", "Tell about {}"]
    asked = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{}"), F.col("n_name")) for x in said]), (F.col("n_nationkey") % 7 + 1).cast("int"))
    k = F.col("n_nationkey") % 7
    scope = matching.question_scope(asked, F.when(k == 0, F.array(F.lit("CVE-2020-0001"))), F.when(k == 5, F.col("n_name")), F.lit(None).cast("boolean"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), scope.alias("scope"))
