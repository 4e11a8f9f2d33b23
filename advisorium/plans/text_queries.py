"""Queries over pages, documents, conversations and events."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advisorium.functions import scoring, text, urls
from advisorium.operators import pages as pg
from advisorium.operators import records as ops
from advisorium.plans.registry import query
from advisorium.sources.tables import table
from advisorium.streaming import runs

HOST = "nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^\\.+|\\.+$', '', 'g'), '')"
COMPOUND = ", ".join(f"'{x}'" for x in urls.COMPOUND)
SITE = f"CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({COMPOUND}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END"
LINKS = "SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS place FROM (SELECT page_id, list_distinct(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS hrefs FROM pages)"


@query("url_host", f"SELECT page_id, {HOST} AS host FROM pages")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    """The host of each page."""
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("registrable_domain", f"SELECT {SITE} AS site, count(*) AS n FROM (SELECT {HOST} AS host FROM pages) GROUP BY 1")
def registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    """Pages by registrable domain."""
    return table(spark, d, "pages").groupBy(urls.registrable(urls.host(F.col("url"))).alias("site")).agg(F.count("*").alias("n"))


@query("same_site", f"SELECT page_id, regexp_replace(host, '^www\\.', '') = 'example.com' OR ends_with(host, '.example.com') AS same FROM (SELECT page_id, {HOST} AS host FROM pages)")
def same_site(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page lies on a site."""
    return table(spark, d, "pages").select("page_id", urls.same_site(urls.host(F.col("url")), F.lit("example.com")).alias("same"))


@query("same_page_groups", f"SELECT concat_ws('|', regexp_replace({HOST}, '^www\\.', ''), lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')), regexp_extract(url, '\\?([^#]*)', 1)) AS page_key, count(DISTINCT url) AS n_urls, min(url) AS first_url FROM pages GROUP BY 1")
def same_page_groups(spark: SparkSession, d: str) -> DataFrame:
    """Urls of the same page."""
    return pg.same_page_groups(table(spark, d, "pages"))


@query("detail_links", f"SELECT page_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(href, '^/[a-z]{{4,}}')) AS n_detail FROM ({LINKS}) GROUP BY page_id")
def detail_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links of a page, and those that look like details."""
    return pg.page_links(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("href").rlike("^/[a-z]{4,}")).alias("n_detail"))


@query("link_graph", f"SELECT a.page_id AS page_id, count(DISTINCT b.page_id) AS linking FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages) a JOIN ({LINKS}) b ON lower(b.href) = a.path GROUP BY a.page_id")
def link_graph(spark: SparkSession, d: str) -> DataFrame:
    """Pages by how many pages link their path."""
    rows = table(spark, d, "pages")
    own = rows.select("page_id", F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)).alias("path"))
    links = pg.page_links(rows).select(F.col("page_id").alias("source"), F.lower("href").alias("path")).distinct()
    return own.join(links, "path").groupBy("page_id").agg(F.countDistinct("source").alias("linking"))


@query("host_suffix_longest", f"SELECT host, org, domain FROM (SELECT host, org, domain, row_number() OVER (PARTITION BY host ORDER BY length(domain) DESC) AS k FROM (SELECT DISTINCT {HOST} AS host FROM pages) JOIN (VALUES ('com', 'any'), ('example.com', 'example'), ('net', 'network'), ('org', 'charity')) o(domain, org) ON host = domain OR ends_with(host, '.' || domain)) WHERE k = 1")
def host_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Each host's organisation by the longest registered suffix."""
    known = spark.createDataFrame([("com", "any"), ("example.com", "example"), ("net", "network"), ("org", "charity")], "domain string, org string")
    return ops.host_suffix_match(table(spark, d, "pages").select(urls.host(F.col("url")).alias("host")).where("host is not null").distinct(), known)


@query("strip_tags", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM pages")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    """The text of pages."""
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("body"))


@query("page_titles", "SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Title and language a page states."""
    return table(spark, d, "pages").select("page_id", F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("feed_items", "SELECT page_id, 0 AS place, 'Page ' || page_id AS title, url AS link, '2001-07-01' AS published FROM pages")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of feeds."""
    body = F.concat(F.lit("<rss><item><title><![CDATA[<b>Page "), F.col("page_id").cast("string"), F.lit("</b>]]></title><link> "), "url", F.lit(" </link><pubDate>2001-07-01</pubDate></item></rss>"))
    return pg.feed_items(table(spark, d, "pages").select("page_id", body.alias("body")), "body")


@query("sitemap_latest", f"SELECT {HOST} AS host, max(page_id) AS lastmod, max_by(url, page_id) AS loc FROM pages GROUP BY 1")
def sitemap_latest(spark: SparkSession, d: str) -> DataFrame:
    """Of each host the latest entry of its sitemap."""
    body = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc><lastmod>"), F.col("page_id").cast("string"), F.lit("</lastmod></url></urlset>"))
    entries = pg.sitemap_entries(table(spark, d, "pages").select("page_id", body.alias("body")), "body").withColumn("at", F.col("lastmod").cast("bigint"))
    return entries.groupBy(urls.host(F.col("loc")).alias("host")).agg(F.max("at").alias("lastmod"), F.max_by("loc", "at").alias("loc"))


@query("section_carry", "SELECT conv_id, 1 AS place, 'summary' AS field, trim(string_split(text, chr(10))[1]) AS line FROM conversations WHERE turn = 0 AND trim(string_split(text, chr(10))[1]) <> '' AND lower(trim(string_split(text, chr(10))[1])) NOT IN ('summary', 'end')")
def section_carry(spark: SparkSession, d: str) -> DataFrame:
    """Lines below a label belong to it until a stop line."""
    first = F.trim(F.split("text", "\n")[0])
    rows = table(spark, d, "conversations").where("turn = 0").select("conv_id", F.concat(F.lit("Summary\n"), first, F.lit("\nEnd\nafter")).alias("t"))
    return pg.carried_sections(rows, "conv_id", "t", {"summary": "summary"}, ["end"])


_TURN_LINES = "SELECT conv_id, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS place FROM (SELECT conv_id, string_split(string_agg(role || chr(10) || text, chr(10) ORDER BY turn, role, text), chr(10)) AS lines FROM conversations GROUP BY conv_id)"
_TURN_MARKS = f"SELECT conv_id, place, trim(raw) AS line, CASE WHEN lower(trim(raw)) = 'system' THEN '' WHEN lower(trim(raw)) IN ('user', 'assistant') THEN lower(trim(raw)) END AS mark FROM ({_TURN_LINES})"


@query("section_carry_turns", f"SELECT conv_id, place, field, line FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS field FROM ({_TURN_MARKS})) WHERE mark IS NULL AND field <> '' AND line <> ''")
def section_carry_turns(spark: SparkSession, d: str) -> DataFrame:
    """All lines of all turns belong to the role that heads them, until the next role; system's stop."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"])), "\n")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(said.alias("t"))
    return pg.carried_sections(rows, "conv_id", "t", {"user": "user", "assistant": "assistant"}, ["system"])


@query("exact_copies", "SELECT text_hash, n, first_id FROM (SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1) WHERE n > 1")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """A23 over texts: groups of exact copies."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def _stop_sql() -> str:
    words = "regexp_split_to_array(lower(substring(text, 1, 6000)), '[^a-zäöüßàâçéèêëîïôûùñáíóú]+')"
    count = lambda x: f"len(list_filter(w, lambda y: y IN ({', '.join(repr(z) for z in x)})))"
    named = sorted(text.STOP_WORDS.items())
    best = "greatest(" + ", ".join(count(x) for _, x in named) + ")"
    cases = " ".join(f"WHEN {count(x)} = {best} THEN '{name}'" for name, x in named)
    return f"SELECT doc_id, CASE WHEN {best} = 0 THEN NULL {cases} END AS lang_guess FROM (SELECT doc_id, {words} AS w FROM documents)"


@query("detect_language", _stop_sql())
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    """Language by stop words; the first characters are what the rule reads."""
    return table(spark, d, "documents").select("doc_id", text.language_by_stop_words(F.col("text")).alias("lang_guess"))


@query("redact_values", "SELECT doc_id, regexp_replace(text, '((?:password|secret|token|api_?key)\\s*[:=]\\s*)\\S+', '\\1***', 'gi') AS clean FROM documents")
def redact_values(spark: SparkSession, d: str) -> DataFrame:
    """Secrets after telling words as asterisks."""
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("clean"))


@query("capped_text", "SELECT doc_id, CASE WHEN length(text) > 120 THEN rtrim(left(text, 120)) || '…' ELSE text END AS short FROM documents")
def capped_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts for display; the cap is the feature."""
    return table(spark, d, "documents").select("doc_id", text.capped(F.col("text"), 120).alias("short"))


@query("menu_detector", "SELECT doc_id, sum(n) >= 8 AND max(n) >= 0.4 * sum(n) AS menu FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\n\\t]+')) AS word FROM documents) WHERE length(word) > 2 GROUP BY ALL) GROUP BY doc_id")
def menu_detector(spark: SparkSession, d: str) -> DataFrame:
    """Texts that repeat like a menu."""
    return pg.repeat_like_menus(table(spark, d, "documents"), "doc_id", "text")


@query("last_exchanges", "SELECT conv_id, list(turn ORDER BY turn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4 GROUP BY conv_id")
def last_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's last four turns, in order."""
    last = ops.top_per_group(table(spark, d, "conversations"), "conv_id", [F.desc("turn")], 4)
    return last.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


@query("conversation_unread", "SELECT conv_id, coalesce(n, 0) AS unread FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' AND turn > 2 GROUP BY conv_id) USING (conv_id)")
def conversation_unread(spark: SparkSession, d: str) -> DataFrame:
    """Conversations and their unread messages, in one aggregation."""
    rows = table(spark, d, "conversations")
    return rows.groupBy("conv_id").agg(F.count_if((F.col("role") == "user") & (F.col("turn") > 2)).alias("unread"))


@query("chat_last_message", "SELECT conv_id, max_by(left(text, 120), turn) AS last_text, count(*) AS n FROM conversations GROUP BY conv_id")
def chat_last_message(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's last message, cut for a list."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by(F.left("text", F.lit(120)), "turn").alias("last_text"), F.count("*").alias("n"))


@query("char_budget_prefix", "SELECT conv_id, turn, running FROM (SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS running FROM conversations) WHERE running <= 2000")
def char_budget(spark: SparkSession, d: str) -> DataFrame:
    """Turns while they stay within a budget of characters."""
    return ops.budgeted_prefix(table(spark, d, "conversations"), "conv_id", "turn", "text", 2000).select("conv_id", "turn", "running")


@query("failure_streak", "WITH i AS (SELECT user_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), r AS (SELECT user_id, island, count(*) FILTER (WHERE failed) AS n FROM i GROUP BY ALL) SELECT user_id, max(n) AS longest, max_by(n, island) AS last FROM r GROUP BY user_id")
def failure_streak(spark: SparkSession, d: str) -> DataFrame:
    """Runs of failures by source."""
    return ops.failure_streaks(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


@query("prev_run", "SELECT event_id, date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events WHERE event_type <> 'error'")
def prev_run(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since the source's previous completed run."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").where("event_type <> 'error'").select("event_id", F.timestamp_diff("SECOND", before, F.col("ts")).alias("gap"))


@query("json_property", "SELECT (props->>'k')::INTEGER AS k, count(*) AS n FROM events GROUP BY 1")
def json_property(spark: SparkSession, d: str) -> DataFrame:
    """A known path of a JSON text."""
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("day_status", "SELECT ts::DATE::VARCHAR AS day, count(*) AS runs, max_by(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def day_status(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each day and the last one's kind."""
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("runs"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("relevance_score", "SELECT doc_id, round(least(1.0, 0.5 + CASE WHEN n_chars > 1000 THEN 0.3 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.15 ELSE 0 END), 2) AS score FROM documents")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    """Additive relevance, clamped."""
    none, base, long, english, most = (F.lit(Decimal(x)) for x in ("0.00", "0.50", "0.30", "0.15", "1.00"))
    total = base + F.when(F.col("n_chars") > 1000, long).otherwise(none) + F.when(F.col("lang") == "en", english).otherwise(none)
    return table(spark, d, "documents").select("doc_id", F.round(F.least(most, total), 2).alias("score"))


@query("label_decision", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 100 WHEN quality = 1 OR toxic = 0 THEN CASE WHEN quality = 1 THEN 60 ELSE 40 END ELSE 0 END::INTEGER AS score FROM labels")
def label_decision(spark: SparkSession, d: str) -> DataFrame:
    """An overall score of weighted parts."""
    return table(spark, d, "labels").select("doc_id", scoring.weighted([(F.col("quality") == 1, 3.0), (F.col("toxic") == 0, 2.0)]).alias("score"))


def _state_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or one in the warehouse where none is set."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/advisorium-shared"


@query("stream_source_state", "SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts)::DATE::VARCHAR AS last_attempt, (max(ts) FILTER (WHERE event_type <> 'error'))::DATE::VARCHAR AS last_success FROM events GROUP BY user_id")
def stream_source_state(spark: SparkSession, d: str) -> DataFrame:
    """ST: each source's state, kept by a stream and read when it has drained."""
    found = runs.drained(spark, f"{d}/events.parque[t]", runs.source_state, "complete", _state_dir(spark))
    return found.select("user_id", "runs", "failures", F.to_date("last_attempt").cast("string").alias("last_attempt"), F.to_date("last_success").cast("string").alias("last_success"))


@query("stream_tumbling_day", "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_day(spark: SparkSession, d: str) -> DataFrame:
    """ST: events by day and kind in tumbling windows."""
    found = runs.drained(spark, f"{d}/events.parque[t]", lambda e: runs.tumbling(e.withColumn("at", F.col("ts").cast("timestamp")), "at", "1 day", "event_type"), "complete", _state_dir(spark))
    return found.select(F.to_date("start").cast("string").alias("day"), "event_type", "n")


@query("stream_dedup_watermark", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """ST02: each event once, whatever the order of files and however late an event is."""
    return runs.deduplicated(spark, f"{d}/events.parque[t]", "event_id", "ts", _state_dir(spark)).read().groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_alerts", "SELECT 'failing:' || user_id AS alert_key, runs, failures FROM (SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY user_id) WHERE failures > 0.1 * runs")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """ST: active alerts from the streamed state."""
    return runs.alerts(runs.drained(spark, f"{d}/events.parque[t]", runs.source_state, "complete", _state_dir(spark)), 0.1)
