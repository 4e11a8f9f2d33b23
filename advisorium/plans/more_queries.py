"""Further queries of the inventory: sources, filters, joins, counters, reference scoring, hashes and batch selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advisorium.functions import scoring, text, urls
from advisorium.operators import records as ops
from advisorium.plans.registry import query
from advisorium.plans.text_queries import HOST
from advisorium.sources.tables import NOW, sql, table, vuln_raw

LINKS = "list_distinct(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1))"


@query("collector_dispatch", "SELECT page_id, CASE WHEN regexp_matches(url, '\\.(rss|atom)') THEN 'feed' WHEN contains(url, 'sitemap') THEN 'sitemap' WHEN contains(url, '/api') THEN 'api' ELSE 'html' END AS collector FROM pages")
def collector_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Which reader a source's url asks for."""
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(url.rlike(r"\.(rss|atom)"), "feed").when(url.contains("sitemap"), "sitemap").when(url.contains("/api"), "api").otherwise("html").alias("collector"))


@query("xml_distinct_ids", sql("SELECT cve_id, [cve_id, 'CVE-1999-0001'] AS ids FROM vuln_raw GROUP BY cve_id"))
def xml_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids of a document in order."""
    body = F.concat(F.lit("<v>"), "cve_id", F.lit("</v><v>"), "cve_id", F.lit("</v><v>CVE-1999-0001</v>"))
    return vuln_raw(spark, d).select("cve_id").distinct().select("cve_id", text.cve_ids(body).alias("ids"))


@query("active_sources", "SELECT s_suppkey AS source_id, s_name AS name FROM supplier WHERE s_acctbal > 0")
def active_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources in use."""
    return table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))


@query("declared_endpoints", "SELECT page_id, list_sort(list_filter(list_distinct(regexp_extract_all(html, '(?:src|href)=\"([^\"]+)\"', 1)), lambda x: regexp_matches(x, '^/[a-z]+$'))) AS endpoints FROM pages")
def declared_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints that a page names."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?:src|href)="([^"]+)"'), F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.array_sort(F.filter(found, lambda x: x.rlike("^/[a-z]+$"))).alias("endpoints"))


@query("clean_context", "SELECT p_partkey AS id, CASE WHEN lower(trim(p_brand)) IN ('n/a', 'unknown', '', 'brand#11') THEN NULL ELSE p_brand END AS vendor FROM part")
def clean_context(spark: SparkSession, d: str) -> DataFrame:
    """Junk words as null."""
    junk = F.lower(F.trim("p_brand")).isin("n/a", "unknown", "", "brand#11")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(~junk, F.col("p_brand")).alias("vendor"))


@query("detail_urls", f"SELECT page_id, CASE WHEN ends_with({HOST}, 'example.com') THEN 'https://example.com/detail/' || page_id ELSE url END AS detail_url FROM pages")
def detail_urls(spark: SparkSession, d: str) -> DataFrame:
    """A record's detail page by its host."""
    known = F.endswith(urls.host(F.col("url")), F.lit("example.com"))
    return table(spark, d, "pages").select("page_id", F.when(known, F.concat(F.lit("https://example.com/detail/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("detail_url"))


@query("local_day_bounds", sql("SELECT vendor, count(*) AS n FROM vuln_raw WHERE published_at >= TIMESTAMP '2001-07-19 22:00:00' AND published_at < TIMESTAMP '2001-07-20 22:00:00' GROUP BY vendor"))
def local_day_bounds(spark: SparkSession, d: str) -> DataFrame:
    """a local day as half-open UTC bounds."""
    start, end = (F.to_utc_timestamp(F.lit(x), "Europe/Paris").cast("timestamp_ntz") for x in ("2001-07-20", "2001-07-21"))
    return vuln_raw(spark, d).where((F.col("published_at") >= start) & (F.col("published_at") < end)).groupBy("vendor").agg(F.count("*").alias("n"))


@query("scope_prefilter", sql("SELECT cve_id, seq FROM vuln_raw WHERE product IN (SELECT p_name FROM part WHERE p_size = 7) OR solution IS NULL AND cve_status IS NOT NULL"))
def scope_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """rows of a monitored product, or without structured information."""
    names = table(spark, d, "part").where("p_size = 7").select(F.col("p_name").alias("product")).distinct().withColumn("scoped", F.lit(True))
    return vuln_raw(spark, d).join(ops.small(names), "product", "left").where("scoped or (solution is null and cve_status is not null)").select("cve_id", "seq")


@query("active_names", "SELECT DISTINCT p_name AS name FROM part WHERE p_size > 5 AND p_type NOT IN (SELECT min(p_type) FROM part)")
def active_names(spark: SparkSession, d: str) -> DataFrame:
    """enabled names whose domain is not disabled."""
    part = table(spark, d, "part")
    off = part.agg(F.min("p_type").alias("p_type"))
    return part.where("p_size > 5").join(F.broadcast(off), "p_type", "left_anti").select(F.col("p_name").alias("name")).distinct()


@query("chat_search", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), 'the') AND role IN ('user', 'assistant')")
def chat_search(spark: SparkSession, d: str) -> DataFrame:
    """messages with a pattern that a role may see."""
    return table(spark, d, "conversations").where(F.lower("text").rlike("the") & F.col("role").isin("user", "assistant")).select("conv_id", "turn")


@query("batch_selection", sql("SELECT cve_id FROM vuln_raw GROUP BY cve_id HAVING count(solution) = 0 AND count(*) > 2"))
def batch_selection(spark: SparkSession, d: str) -> DataFrame:
    """ids without a solution that have more than two references."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.count("solution").alias("s"), F.count("*").alias("n")).where("s = 0 and n > 2").select("cve_id")


@query("recipients", "WITH r AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), c AS (SELECT count(*) FILTER (WHERE last >= TIMESTAMP '2024-01-29 23:00:00') AS recent FROM r) SELECT user_id FROM r, c WHERE CASE WHEN recent > 0 THEN last >= TIMESTAMP '2024-01-29 23:00:00' ELSE true END")
def recipients(spark: SparkSession, d: str) -> DataFrame:
    """those seen lately, or all if none was."""
    seen = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    recent = F.col("last") >= ops.ts("2024-01-29 23:00:00")
    any_ = seen.agg(F.bool_or(recent).alias("any_recent"))
    return seen.join(F.broadcast(any_)).where(recent | ~F.col("any_recent")).select("user_id")


@query("week_preset", sql("SELECT date_trunc('week', published_at)::DATE::VARCHAR AS week, count(*) AS n FROM vuln_raw GROUP BY 1"))
def week_preset(spark: SparkSession, d: str) -> DataFrame:
    """rows by ISO week."""
    return vuln_raw(spark, d).groupBy(F.to_date(F.date_trunc("week", "published_at")).cast("string").alias("week")).agg(F.count("*").alias("n"))


@query("prefix_containment_join", "SELECT DISTINCT n_name AS name, r_name AS region FROM nation JOIN region ON starts_with(n_name, left(r_name, 1)) OR contains(n_name, left(r_name, 1))")
def prefix_containment(spark: SparkSession, d: str) -> DataFrame:
    """A containment join against a counted small side."""
    region = ops.small(table(spark, d, "region"))
    met = F.startswith("n_name", F.left("r_name", F.lit(1))) | F.contains("n_name", F.left("r_name", F.lit(1)))
    return table(spark, d, "nation").join(region, met).select(F.col("n_name").alias("name"), F.col("r_name").alias("region")).distinct()


@query("stored_consistency", sql("SELECT source_id, count(DISTINCT cve_id) AS missing FROM vuln_raw v WHERE is_new AND NOT EXISTS (SELECT 1 FROM vuln_raw o WHERE o.cve_id = v.cve_id AND NOT o.is_new) GROUP BY source_id"))
def stored_consistency(spark: SparkSession, d: str) -> DataFrame:
    """By source, collected ids that are not stored."""
    rows = vuln_raw(spark, d)
    return rows.where("is_new").join(rows.where("not is_new").select("cve_id"), "cve_id", "left_anti").groupBy("source_id").agg(F.countDistinct("cve_id").alias("missing"))


@query("domain_counts_default", "SELECT n.n_name AS domain, coalesce(c.n, 0) AS n FROM nation n LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) c ON n.n_nationkey = c.s_nationkey")
def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by domain, zero where there is none."""
    counted = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(counted, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("domain"), F.coalesce("n", F.lit(0)).alias("n"))


@query("advisory_by_url", sql("SELECT published_at::DATE::VARCHAR || '/' || vendor AS url, count(DISTINCT cve_id) AS n_ids, min(cve_id) AS first_id FROM vuln_raw GROUP BY 1"))
def advisory_by_url(spark: SparkSession, d: str) -> DataFrame:
    """One page, many ids."""
    url = F.concat(F.to_date("published_at").cast("string"), F.lit("/"), "vendor")
    return vuln_raw(spark, d).groupBy(url.alias("url")).agg(F.countDistinct("cve_id").alias("n_ids"), F.min("cve_id").alias("first_id"))


@query("source_status_lists", "SELECT CASE WHEN f = 0 THEN 'ok' WHEN f < 5 THEN 'degraded' ELSE 'failed' END AS status, list_sort(list(user_id)) AS sources FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS f FROM events GROUP BY user_id) GROUP BY 1")
def source_status_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sources by outcome; the lists hold sources, not runs."""
    failures = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("f"))
    status = F.when(F.col("f") == 0, "ok").when(F.col("f") < 5, "degraded").otherwise("failed")
    return failures.groupBy(status.alias("status")).agg(F.array_sort(F.collect_list("user_id")).alias("sources"))


@query("distinct_values", sql("SELECT DISTINCT 'vendor' AS field, vendor AS value FROM vuln_raw UNION ALL SELECT DISTINCT 'domain', domain FROM vuln_raw"))
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """A10: distinct values of several fields in one pass."""
    pair = F.explode(F.array(F.struct(F.lit("vendor").alias("field"), F.col("vendor").alias("value")), F.struct(F.lit("domain").alias("field"), F.col("domain").alias("value"))))
    return vuln_raw(spark, d).select(pair.alias("p")).select("p.*").distinct()


@query("group_summary", sql("SELECT domain, count(*) FILTER (WHERE cvss_score >= 9) AS critical, count(*) FILTER (WHERE cvss_score >= 7 AND cvss_score < 9) AS high, count(DISTINCT source_id) AS sources FROM vuln_raw GROUP BY domain"))
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    """A group's severity histogram and sources."""
    name = scoring.severity(F.col("cvss_score"))
    return vuln_raw(spark, d).groupBy("domain").agg(F.count_if(name == "critical").alias("critical"), F.count_if(name == "high").alias("high"), F.countDistinct("source_id").alias("sources"))


@query("publish_check", sql("SELECT source_name, count(*) AS total, count(published_at) AS dated, count(*) FILTER (WHERE published_at >= TIMESTAMP '2001-07-01') AS recent, max(published_at)::DATE::VARCHAR AS latest FROM vuln_raw GROUP BY source_name"))
def publish_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a source publishes."""
    return vuln_raw(spark, d).groupBy("source_name").agg(F.count("*").alias("total"), F.count("published_at").alias("dated"), F.count_if(F.col("published_at") >= ops.ts("2001-07-01")).alias("recent"), F.to_date(F.max("published_at")).cast("string").alias("latest"))


@query("last_change", sql("SELECT cve_id, list(source_name ORDER BY collected_at, seq)[-1] AS last_source FROM vuln_raw GROUP BY cve_id"))
def last_change(spark: SparkSession, d: str) -> DataFrame:
    """The last entry of a history, without gathering it."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.max_by("source_name", F.struct("collected_at", "seq")).alias("last_source"))


@query("stable_sorts", sql("SELECT cve_id, cvss_score, seq, row_number() OVER (PARTITION BY vendor ORDER BY coalesce(cvss_score, -1) DESC, published_at DESC NULLS LAST, seq)::INTEGER AS place FROM vuln_raw QUALIFY place <= 10"))
def stable_sorts(spark: SparkSession, d: str) -> DataFrame:
    """Each vendor's ten by score, missing as -1, then date, missing last."""
    order = [F.coalesce("cvss_score", F.lit(-1.0)).desc(), F.desc_nulls_last("published_at"), F.col("seq")]
    return ops.top_per_group(vuln_raw(spark, d), "vendor", order, 10).select("cve_id", "cvss_score", "seq", F.col("rank").alias("place"))


@query("list_merge", sql("SELECT cve_id, list_sort(list(DISTINCT r)) AS refs FROM (SELECT cve_id, unnest(string_split('https://a/' || product || ' https://b/' || vendor, ' https')) AS r FROM vuln_raw) GROUP BY cve_id"))
def list_merge(spark: SparkSession, d: str) -> DataFrame:
    """Space-joined references split and merged as a set."""
    joined = F.concat(F.lit("https://a/"), "product", F.lit(" https://b/"), "vendor")
    return vuln_raw(spark, d).select("cve_id", F.explode(F.split(joined, " https")).alias("r")).groupBy("cve_id").agg(F.array_sort(F.collect_set("r")).alias("refs"))


@query("rich_text_kept", sql("SELECT cve_id, max_by(product, (length(product), seq)) AS description FROM vuln_raw GROUP BY cve_id"))
def rich_text_kept(spark: SparkSession, d: str) -> DataFrame:
    """The longest text is never shortened."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.max_by("product", F.struct(F.length("product"), F.col("seq"))).alias("description"))


@query("bulletin_hash", sql("SELECT product, sha1(array_to_string(list_sort(list(DISTINCT cve_id)), ',') || '|' || product) AS bulletin_hash FROM vuln_raw WHERE published_at >= TIMESTAMP '2001-07-01' GROUP BY product"))
def bulletin_hash(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of a bulletin's sorted ids."""
    body = F.concat(F.array_join(F.array_sort(F.collect_set("cve_id")), ","), F.lit("|"), F.col("product"))
    return vuln_raw(spark, d).where(F.col("published_at") >= ops.ts("2001-07-01")).groupBy("product").agg(F.sha1(body).alias("bulletin_hash"))


@query("provenance_conflicts", sql("SELECT cve_id, count(*) AS n FROM (SELECT cve_id, vendor, first_value(vendor) OVER (PARTITION BY cve_id ORDER BY seq) AS recorded FROM vuln_raw) WHERE vendor <> recorded GROUP BY cve_id"))
def provenance_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Values that differ from the recorded one."""
    recorded = F.first("vendor").over(Window.partitionBy("cve_id").orderBy("seq"))
    return vuln_raw(spark, d).withColumn("recorded", recorded).where("vendor <> recorded").groupBy("cve_id").agg(F.count("*").alias("n"))


@query("status_never_worse", sql("SELECT cve_id, CASE WHEN bool_or(solution IS NOT NULL) THEN 'completed' WHEN bool_or(is_new) THEN 'pending' ELSE 'failed' END AS status FROM vuln_raw GROUP BY cve_id"))
def status_never_worse(spark: SparkSession, d: str) -> DataFrame:
    """A failure never replaces a completion."""
    rank = F.when(F.col("solution").isNotNull(), 3).when(F.col("is_new"), 2).otherwise(1)
    names = F.array(F.lit("failed"), F.lit("pending"), F.lit("completed"))
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.element_at(names, F.max(rank)).alias("status"))


@query("reference_score", f"SELECT page_id, (CASE WHEN ends_with(host, '.example.com') THEN 100 WHEN ends_with(host, '.org') THEN 50 ELSE 0 END + CASE WHEN regexp_matches(url, '/(en|de)/') THEN 6 ELSE 0 END - CASE WHEN contains(url, 'ref=') THEN 20 ELSE 0 END)::INTEGER AS score FROM (SELECT page_id, url, {HOST} AS host FROM pages)")
def reference_score(spark: SparkSession, d: str) -> DataFrame:
    """References by domain, path and trackers."""
    host = urls.host(F.col("url"))
    base = F.when(F.endswith(host, F.lit(".example.com")), 100).when(F.endswith(host, F.lit(".org")), 50).otherwise(0)
    score = base + F.when(F.col("url").rlike("/(en|de)/"), 6).otherwise(0) - F.when(F.col("url").contains("ref="), 20).otherwise(0)
    return table(spark, d, "pages").select("page_id", score.alias("score"))


@query("best_reference", f"SELECT host, min(url) AS url, count(*) AS n FROM (SELECT url, {HOST} AS host FROM pages) GROUP BY host")
def best_reference(spark: SparkSession, d: str) -> DataFrame:
    """Of each host one page, the first in order."""
    return table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("url").alias("url"), F.count("*").alias("n"))


@query("url_signals", f"SELECT page_id, regexp_matches(host, '^[0-9.]+$') AS is_ip, starts_with(url, 'https:') AS secure, contains(host, 'xn--') AS punycode, len(string_split(host, '.')) > 3 AS deep FROM (SELECT page_id, url, {HOST} AS host FROM pages)")
def url_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signs of an inauthentic url."""
    host = urls.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.rlike("^[0-9.]+$").alias("is_ip"), F.startswith("url", F.lit("https:")).alias("secure"), host.contains("xn--").alias("punycode"), (F.size(F.split(host, r"\.")) > 3).alias("deep"))


@query("categories", "SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(text), 'password|token') THEN 'secret' END, CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN regexp_matches(text, '[Ll]icen[cs]e') THEN 'licence' END], lambda x: x IS NOT NULL) AS categories FROM documents")
def categories(spark: SparkSession, d: str) -> DataFrame:
    """All categories that a text falls under."""
    marks = F.array(F.when(F.lower("text").rlike("password|token"), F.lit("secret")), F.when(F.contains("text", F.lit("@")), F.lit("contact")), F.when(F.col("text").rlike("[Ll]icen[cs]e"), F.lit("licence")))
    return table(spark, d, "documents").select("doc_id", F.filter(marks, lambda x: x.isNotNull()).alias("categories"))


@query("date_classes", sql(f"SELECT CASE WHEN published_at > TIMESTAMP '{NOW}' THEN 'future' WHEN published_at < TIMESTAMP '1999-01-01' THEN 'old' WHEN published_at > collected_at THEN 'after' ELSE 'coherent' END AS class, count(*) AS n FROM vuln_raw GROUP BY 1"))
def date_classes(spark: SparkSession, d: str) -> DataFrame:
    """Publication dates by what is wrong with them."""
    published = F.col("published_at")
    named = F.when(published > ops.ts(NOW), "future").when(published < ops.ts("1999-01-01"), "old").when(published > F.col("collected_at"), "after").otherwise("coherent")
    return vuln_raw(spark, d).groupBy(named.alias("class")).agg(F.count("*").alias("n"))


@query("link_counts", f"SELECT n, count(*) AS pages FROM (SELECT len({LINKS}) AS n FROM pages) GROUP BY n")
def link_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages by their number of distinct links."""
    return table(spark, d, "pages").groupBy(F.size(urls.links(F.col("html"))).cast("bigint").alias("n")).agg(F.count("*").alias("pages"))


@query("discussion_citations", sql("SELECT DISTINCT cve_id, cve_id || '|feed|https://x/' || vendor AS discussion_key FROM vuln_raw"))
def discussion_citations(spark: SparkSession, d: str) -> DataFrame:
    """Texts that cite an id exactly, with their unique key."""
    note = F.concat(F.lit("about "), F.lower("cve_id"), F.lit("; not "), "cve_id", F.lit("9"))
    cited = vuln_raw(spark, d).where(F.array_contains(text.cve_ids(note), F.col("cve_id")))
    return cited.select("cve_id", F.concat_ws("|", "cve_id", F.lit("feed"), F.concat(F.lit("https://x/"), "vendor")).alias("discussion_key")).distinct()


@query("context_strings", "SELECT conv_id, string_agg(role || ': ' || left(text, 60), ' / ' ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2 GROUP BY conv_id")
def context_strings(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's last exchanges as one line."""
    last = ops.top_per_group(table(spark, d, "conversations"), "conv_id", [F.desc("turn")], 2)
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.left("text", F.lit(60))).alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["line"]), " / ").alias("context"))
