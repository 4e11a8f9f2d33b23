"""Queries over vulnerability records: lists, counters, bulletins, merges, joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advisorium.functions import scoring, text
from advisorium.operators import catalogue
from advisorium.operators import records as ops
from advisorium.plans.registry import query
from advisorium.sources.tables import NOW, sql, table, tasks_for, vuln_raw

SEV = "CASE WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' WHEN cvss_score IS NOT NULL THEN 'low' END"
RANK = f"CASE {SEV} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
DAY = "2001-07-20"
day = lambda c: F.to_date(c).cast("string")


def severity() -> Column:
    return scoring.severity(F.col("cvss_score"))


@query("list_page", sql("SELECT cve_id, vendor, product, cvss_score, published_at::DATE::VARCHAR AS published, seq FROM vuln_raw WHERE cve_status IS DISTINCT FROM 'rejected' ORDER BY published_at DESC, seq OFFSET 40 LIMIT 20"))
def list_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of twenty, newest first; the page is the feature."""
    rows = ops.not_rejected(vuln_raw(spark, d)).orderBy(F.desc_nulls_last("published_at"), "seq").offset(40).limit(20)
    return rows.select("cve_id", "vendor", "product", "cvss_score", day("published_at").alias("published"), "seq")


@query("list_page_rejected_nullsafe", sql("SELECT coalesce(cve_status, 'none') AS status, count(*) AS n FROM vuln_raw WHERE cve_status IS DISTINCT FROM 'rejected' GROUP BY 1"))
def rejected_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    """revoked rows go, rows without a status stay."""
    return ops.not_rejected(vuln_raw(spark, d)).groupBy(F.coalesce("cve_status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@query("equality_filters", sql(f"SELECT cve_id, seq FROM vuln_raw WHERE {SEV} = 'critical' AND is_new AND domain = 'PROMO'"))
def equality_filters(spark: SparkSession, d: str) -> DataFrame:
    """severity, newness and category."""
    return vuln_raw(spark, d).where((severity() == "critical") & F.col("is_new") & (F.col("domain") == "PROMO")).select("cve_id", "seq")


@query("product_membership", sql("SELECT cve_id, list_sort(list(DISTINCT product)) AS products FROM vuln_raw GROUP BY cve_id HAVING list_contains(list(DISTINCT product), (SELECT min(p_name) FROM part))"))
def product_membership(spark: SparkSession, d: str) -> DataFrame:
    """ids whose affected products hold a name."""
    name = table(spark, d, "part").agg(F.min("p_name").alias("wanted"))
    found = vuln_raw(spark, d).groupBy("cve_id").agg(F.array_sort(F.collect_set("product")).alias("products"))
    return found.withColumn("p", F.explode("products")).join(ops.small(name), F.col("p") == F.col("wanted")).select("cve_id", "products")


@query("search_regex_any", sql("SELECT cve_id, product, vendor, seq FROM vuln_raw WHERE regexp_matches(cve_id, '(?i)2001-1[0-9]*7$') OR regexp_matches(product, '(?i)steel')"))
def search_regex_any(spark: SparkSession, d: str) -> DataFrame:
    """a pattern in the id or the product, in either case."""
    return vuln_raw(spark, d).where(F.col("cve_id").rlike("(?i)2001-1[0-9]*7$") | F.col("product").rlike("(?i)steel")).select("cve_id", "product", "vendor", "seq")


@query("published_range", sql("SELECT cve_id, seq FROM vuln_raw WHERE published_at >= TIMESTAMP '2000-03-01' AND published_at < TIMESTAMP '2000-03-11'"))
def published_range(spark: SparkSession, d: str) -> DataFrame:
    """published in closed days, the last counting whole."""
    return vuln_raw(spark, d).where((F.col("published_at") >= ops.ts("2000-03-01")) & (F.col("published_at") < ops.ts("2000-03-11"))).select("cve_id", "seq")


for _name, _column in (("published_on_day", "published_at"), ("collected_on_day", "collected_at")):
    query(_name, sql(f"SELECT cve_id, seq FROM vuln_raw WHERE {_column} >= TIMESTAMP '{DAY}' AND {_column} < TIMESTAMP '{DAY}' + INTERVAL 1 DAY"))(
        lambda spark, d, c=_column: vuln_raw(spark, d).where(ops.on_day(c, DAY)).select("cve_id", "seq")
    )


@query("updated_on_day", sql(f"SELECT cve_id, count(*) AS n FROM vuln_raw GROUP BY cve_id HAVING max(collected_at) >= TIMESTAMP '{DAY}' AND min(collected_at) < TIMESTAMP '{DAY}'"))
def updated_on_day(spark: SparkSession, d: str) -> DataFrame:
    """last seen from the day on, first seen before it."""
    seen = vuln_raw(spark, d).groupBy("cve_id").agg(F.min("collected_at").alias("first"), F.max("collected_at").alias("last"), F.count("*").alias("n"))
    return seen.where((F.col("last") >= ops.ts(DAY)) & (F.col("first") < ops.ts(DAY))).select("cve_id", "n")


@query("recent_or_collected", sql(f"SELECT cve_id, seq FROM vuln_raw WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 45 DAYS OR collected_at >= TIMESTAMP '{NOW}' - INTERVAL 45 DAYS"))
def recent_or_collected(spark: SparkSession, d: str) -> DataFrame:
    """published or collected in the last 45 days."""
    return vuln_raw(spark, d).where(ops.recent(NOW, 45)).select("cve_id", "seq")


@query("period_or", sql("SELECT cve_id, seq FROM vuln_raw WHERE (published_at >= TIMESTAMP '1998-01-01' AND published_at < TIMESTAMP '1998-02-01') OR (collected_at >= TIMESTAMP '1998-01-01' AND collected_at < TIMESTAMP '1998-02-01')"))
def period_or(spark: SparkSession, d: str) -> DataFrame:
    """published or collected in an explicit period."""
    return vuln_raw(spark, d).where(ops.period("1998-01-01", "1998-01-31")).select("cve_id", "seq")


@query("unread", sql("SELECT vendor, count(*) AS n FROM vuln_raw WHERE is_new GROUP BY vendor"))
def unread(spark: SparkSession, d: str) -> DataFrame:
    """unread rows by vendor."""
    return vuln_raw(spark, d).where("is_new").groupBy("vendor").agg(F.count("*").alias("n"))


@query("daily_watch", sql("SELECT v.cve_id, seq, CASE WHEN k.cve_id IS NOT NULL THEN 'known' ELSE 'published' END AS why FROM vuln_raw v LEFT JOIN (SELECT DISTINCT cve_id FROM vuln_raw WHERE collected_at < TIMESTAMP '1995-03-01') k ON v.cve_id = k.cve_id WHERE k.cve_id IS NOT NULL OR (published_at >= TIMESTAMP '2001-07-01' AND published_at < TIMESTAMP '2001-08-01')"))
def daily_watch(spark: SparkSession, d: str) -> DataFrame:
    """known ids, and unknown ones published in the window."""
    rows = vuln_raw(spark, d)
    return ops.watch(rows, rows.where(F.col("collected_at") < ops.ts("1995-03-01")), "2001-07-01", "2001-08-01").select("cve_id", "seq", "why")


@query("nlq_filter", sql(f"SELECT cve_id, seq FROM vuln_raw WHERE {SEV} = 'high' AND cvss_score >= 8 AND published_at >= TIMESTAMP '1999-01-01' AND published_at < TIMESTAMP '2000-01-01' AND regexp_matches(lower(concat_ws(' ', vendor, product)), '\\bblue\\b')"))
def nlq_filter(spark: SparkSession, d: str) -> DataFrame:
    """severity, score, period and a whole word, all at once."""
    words = F.lower(F.concat_ws(" ", "vendor", "product")).rlike(r"\bblue\b")
    dated = (F.col("published_at") >= ops.ts("1999-01-01")) & (F.col("published_at") < ops.ts("2000-01-01"))
    return vuln_raw(spark, d).where((severity() == "high") & (F.col("cvss_score") >= 8) & dated & words).select("cve_id", "seq")


@query("incomplete_rows", sql("SELECT domain, count(*) AS n FROM vuln_raw WHERE solution IS NULL OR cve_status IS NOT NULL GROUP BY domain"))
def incomplete_rows(spark: SparkSession, d: str) -> DataFrame:
    """rows that lack a solution or are revoked, by domain."""
    return vuln_raw(spark, d).where("solution is null or cve_status is not null").groupBy("domain").agg(F.count("*").alias("n"))


@query("top_cvss_compound", sql("SELECT cve_id, cvss_score, seq FROM vuln_raw ORDER BY cvss_score DESC, published_at DESC, seq LIMIT 40"))
def top_cvss(spark: SparkSession, d: str) -> DataFrame:
    """The forty highest scores, newest first among equals."""
    return vuln_raw(spark, d).orderBy(F.desc("cvss_score"), F.desc("published_at"), "seq").limit(40).select("cve_id", "cvss_score", "seq")


@query("null_first_budget", sql("SELECT cve_id, solution, seq FROM vuln_raw ORDER BY solution IS NULL DESC, seq LIMIT 40"))
def null_first(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a solution first, within a budget of forty."""
    return vuln_raw(spark, d).orderBy(F.col("solution").isNull().desc(), "seq").limit(40).select("cve_id", "solution", "seq")


@query("top_n_per_product", sql("SELECT * FROM (SELECT product, cve_id, seq, row_number() OVER (PARTITION BY product ORDER BY cvss_score DESC, seq)::INTEGER AS rank FROM vuln_raw) WHERE rank <= 5"))
def top_n_per_product(spark: SparkSession, d: str) -> DataFrame:
    """Each product's five highest."""
    return ops.top_per_group(vuln_raw(spark, d), "product", [F.desc("cvss_score"), F.col("seq")], 5).select("product", "cve_id", "seq", "rank")


CARDS = sql(f"SELECT product, min_by(vendor, seq) AS vendor, count(DISTINCT cve_id) AS n_cves, max(cvss_score) AS max_cvss, max({RANK})::INTEGER AS max_rank, max(published_at)::DATE::VARCHAR AS latest FROM vuln_raw WHERE cve_status IS DISTINCT FROM 'rejected' GROUP BY product")


@query("product_cards", CARDS)
def product_cards(spark: SparkSession, d: str) -> DataFrame:
    """Bulletin cards by product: first vendor, distinct ids, highest score and severity, latest publication."""
    rows = ops.not_rejected(vuln_raw(spark, d))
    return rows.groupBy("product").agg(
        F.min_by("vendor", "seq").alias("vendor"), F.countDistinct("cve_id").alias("n_cves"), F.max("cvss_score").alias("max_cvss"),
        F.max(scoring.severity_rank(severity())).alias("max_rank"), day(F.max("published_at")).alias("latest"),
    )


@query("product_counters", sql("SELECT product, count(*) AS n, count(*) FILTER (WHERE is_new) AS n_new FROM vuln_raw GROUP BY product"))
def product_counters(spark: SparkSession, d: str) -> DataFrame:
    """Rows and new rows by product."""
    return vuln_raw(spark, d).groupBy("product").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new"))


@query("severity_distribution", sql(f"SELECT {SEV} AS severity, count(*) AS n FROM vuln_raw GROUP BY 1"))
def severity_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Rows by severity."""
    return vuln_raw(spark, d).groupBy(severity().alias("severity")).agg(F.count("*").alias("n"))


@query("top_vendors", sql("SELECT vendor, count(*) AS n FROM vuln_raw WHERE vendor NOT IN ('', 'n/a', 'Unknown') GROUP BY vendor ORDER BY n DESC, vendor LIMIT 8"))
def top_vendors(spark: SparkSession, d: str) -> DataFrame:
    """The eight vendors with most rows."""
    return vuln_raw(spark, d).where(~F.col("vendor").isin("", "n/a", "Unknown")).groupBy("vendor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vendor").limit(8)


COMPLETE = "round_even((CASE WHEN vendor <> '' THEN 1 ELSE 0 END + CASE WHEN product <> '' THEN 1 ELSE 0 END + CASE WHEN solution <> '' THEN 1 ELSE 0 END + CASE WHEN cve_status <> '' THEN 1 ELSE 0 END) * 100 / 4, 0)::INTEGER"


@query("avg_completeness", sql(f"SELECT round_even(avg({COMPLETE}), 0)::INTEGER AS average FROM vuln_raw"))
def avg_completeness(spark: SparkSession, d: str) -> DataFrame:
    """The average share of filled fields."""
    filled = scoring.completeness([F.col(c) for c in ("vendor", "product", "solution", "cve_status")])
    return vuln_raw(spark, d).agg(F.bround(F.avg(filled)).cast("int").alias("average"))


@query("products_per_domain", "SELECT p_type AS domain, count(DISTINCT p_name) AS n FROM part GROUP BY 1")
def products_per_domain(spark: SparkSession, d: str) -> DataFrame:
    """Products by domain."""
    return table(spark, d, "part").groupBy(F.col("p_type").alias("domain")).agg(F.countDistinct("p_name").alias("n"))


@query("dashboard_counters", sql(f"SELECT count(*) AS total, count(*) FILTER (WHERE is_new) AS n_new, count(*) FILTER (WHERE published_at::DATE = DATE '{DAY}') AS today, count(*) FILTER (WHERE {SEV} = 'critical') AS critical, count(*) FILTER (WHERE {SEV} = 'high') AS high FROM vuln_raw"))
def dashboard_counters(spark: SparkSession, d: str) -> DataFrame:
    """All counters in one scan."""
    return vuln_raw(spark, d).agg(F.count("*").alias("total"), F.count_if("is_new").alias("n_new"), F.count_if(ops.on_day("published_at", DAY)).alias("today"), F.count_if(severity() == "critical").alias("critical"), F.count_if(severity() == "high").alias("high"))


@query("daily_digest", sql(f"SELECT coalesce(product, 'other') AS product, count(*) AS total, count(*) FILTER (WHERE {SEV} = 'critical') AS critical, list(cve_id ORDER BY {RANK} DESC, cvss_score DESC, seq)[1:3] AS first_ids FROM vuln_raw WHERE is_new AND collected_at >= TIMESTAMP '2001-06-01' GROUP BY 1"))
def daily_digest(spark: SparkSession, d: str) -> DataFrame:
    """Unread rows by product with counters, and the three worst ids, which alone are ranked and gathered."""
    rows = vuln_raw(spark, d).where(F.col("is_new") & (F.col("collected_at") >= ops.ts("2001-06-01"))).withColumn("product", F.coalesce("product", F.lit("other")))
    order = [scoring.severity_rank(severity()).desc(), F.desc("cvss_score"), F.col("seq")]
    worst = ops.top_per_group(rows, "product", order, 3).groupBy("product").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cve_id"))), lambda x: x["cve_id"]).alias("first_ids"))
    counts = rows.groupBy("product").agg(F.count("*").alias("total"), F.count_if(severity() == "critical").alias("critical"))
    return counts.join(worst, "product").select("product", "total", "critical", "first_ids")


@query("bulletin_header", sql(f"SELECT product, count(*) AS n, max(cvss_score) AS max_cvss, max({RANK})::INTEGER AS max_rank, min(published_at)::DATE::VARCHAR AS since FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY published_at DESC, seq) AS k FROM vuln_raw) WHERE k <= 80 GROUP BY product"))
def bulletin_header(spark: SparkSession, d: str) -> DataFrame:
    """Facts over each product's eighty latest rows."""
    latest = ops.top_per_group(vuln_raw(spark, d), "product", [F.desc("published_at"), F.col("seq")], 80)
    return latest.groupBy("product").agg(F.count("*").alias("n"), F.max("cvss_score").alias("max_cvss"), F.max(scoring.severity_rank(severity())).alias("max_rank"), day(F.min("published_at")).alias("since"))


@query("multi_agg_maxby", sql("SELECT cve_id, max(cvss_score) AS cvss_score, max_by(product, (cvss_score, seq)) AS product, min(published_at)::DATE::VARCHAR AS published FROM vuln_raw GROUP BY cve_id"))
def multi_agg_maxby(spark: SparkSession, d: str) -> DataFrame:
    """The highest score with the product it belongs to; of equal scores the last to arrive."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.max("cvss_score").alias("cvss_score"), F.max_by("product", F.struct("cvss_score", "seq")).alias("product"), day(F.min("published_at")).alias("published"))


@query("argmax_ties", sql("SELECT cve_id, seq, cvss_score FROM (SELECT *, max(cvss_score) OVER (PARTITION BY cve_id) AS m FROM vuln_raw) WHERE cvss_score = m"))
def argmax_ties(spark: SparkSession, d: str) -> DataFrame:
    """All rows tied at their id's highest score."""
    return vuln_raw(spark, d).withColumn("m", F.max("cvss_score").over(Window.partitionBy("cve_id"))).where("cvss_score = m").select("cve_id", "seq", "cvss_score")


@query("mode_vendor", sql("SELECT domain, min_by(vendor, (-n, vendor)) AS vendor, max(n) AS n FROM (SELECT domain, vendor, count(*) AS n FROM vuln_raw GROUP BY ALL) GROUP BY domain"))
def mode_vendor(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value of a group, ties to the smallest."""
    counts = vuln_raw(spark, d).groupBy("domain", "vendor").agg(F.count("*").alias("n"))
    return counts.groupBy("domain").agg(F.min_by("vendor", F.struct(-F.col("n"), F.col("vendor"))).alias("vendor"), F.max("n").alias("n"))


@query("consensus_value", sql("SELECT cve_id, CASE WHEN count(DISTINCT product) = 1 THEN min(product) END AS product FROM vuln_raw GROUP BY cve_id"))
def consensus_value(spark: SparkSession, d: str) -> DataFrame:
    """The one distinct product of an id, or null."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.when(F.min("product") == F.max("product"), F.min("product")).alias("product"))


@query("status_histogram", "SELECT CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status, count(*) AS n, count(DISTINCT user_id) AS sources FROM events GROUP BY 1")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Runs and sources by outcome."""
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return table(spark, d, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sources"))


@query("audit_counts", sql("SELECT count(*) FILTER (WHERE solution IS NULL) AS no_solution, count(*) FILTER (WHERE cve_status IS NOT NULL) AS revoked, count(*) FILTER (WHERE collected_at < published_at) AS early, count(*) FILTER (WHERE cvss_score > 10) AS impossible, count(*) FILTER (WHERE NOT regexp_matches(cve_id, '^CVE-\\d{4}-\\d{4,}$')) AS malformed FROM vuln_raw"))
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Independent predicates over one scan."""
    return vuln_raw(spark, d).agg(
        F.count_if(F.col("solution").isNull()).alias("no_solution"), F.count_if(F.col("cve_status").isNotNull()).alias("revoked"), F.count_if(F.col("collected_at") < F.col("published_at")).alias("early"),
        F.count_if(F.col("cvss_score") > 10).alias("impossible"), F.count_if(~F.col("cve_id").rlike(r"^CVE-\d{4}-\d{4,}$")).alias("malformed"),
    )


@query("contamination_groups", sql("SELECT * FROM (SELECT 'product' AS field, product AS value, count(DISTINCT cve_id) AS n FROM vuln_raw GROUP BY product UNION ALL SELECT 'source_name', source_name, count(DISTINCT cve_id) FROM vuln_raw GROUP BY source_name) WHERE n >= 3"))
def contamination_groups(spark: SparkSession, d: str) -> DataFrame:
    """Values that at least three ids share exactly."""
    tasks = tasks_for(spark, d, "lineitem")
    return ops.contamination(vuln_raw(spark, d, tasks), ["product", "source_name"], 3, tasks)


@query("sample_per_source", sql("SELECT source_name, cve_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY seq) AS k FROM vuln_raw) WHERE k <= 3"))
def sample_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Three rows of each source; the sample is the feature."""
    return ops.top_per_group(vuln_raw(spark, d), "source_name", [F.col("seq")], 3).select("source_name", "cve_id", "seq")


@query("join_sources_left", "SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(s_name, '—') AS source, count(*) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY ALL")
def join_sources_left(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their source's name, or a dash."""
    source = ops.small(table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name"))
    joined = table(spark, d, "lineitem").join(source, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.groupBy("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce("s_name", F.lit("—")).alias("source")).agg(F.count("*").alias("n"))


for _name, _kind, _word in (("known_semi", "left_semi", "IN"), ("unknown_anti", "left_anti", "NOT IN")):
    query(_name, sql(f"SELECT cve_id, seq FROM vuln_raw WHERE cve_id {_word} (SELECT cve_id FROM vuln_raw WHERE collected_at < TIMESTAMP '1996-01-01')"))(
        lambda spark, d, kind=_kind: vuln_raw(spark, d).join(vuln_raw(spark, d).where(F.col("collected_at") < ops.ts("1996-01-01")).select("cve_id"), "cve_id", kind).select("cve_id", "seq")
    )

HALVES = """
m AS (SELECT cve_id, collected_at < TIMESTAMP '1998-06-01' AS early, min_by(vendor, seq) AS vendor, min_by(product, seq) AS product, max(cvss_score) AS cvss_score FROM vuln_raw GROUP BY ALL),
o AS (SELECT * FROM m WHERE early), n AS (SELECT * FROM m WHERE NOT early)"""


@query("upsert_full_outer", f"""WITH {sql('')[5:].strip()}, {HALVES.strip()}
SELECT coalesce(n.cve_id, o.cve_id) AS cve_id,
  CASE WHEN o.cve_id IS NULL THEN 'new' WHEN n.cve_id IS NULL THEN 'removed' WHEN n.vendor IS DISTINCT FROM o.vendor OR n.product IS DISTINCT FROM o.product OR n.cvss_score IS DISTINCT FROM o.cvss_score THEN 'updated' ELSE 'unchanged' END AS status,
  CASE WHEN o.cve_id IS NULL OR n.cve_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n.vendor IS DISTINCT FROM o.vendor THEN 'vendor' END, CASE WHEN n.product IS DISTINCT FROM o.product THEN 'product' END, CASE WHEN n.cvss_score IS DISTINCT FROM o.cvss_score THEN 'cvss_score' END) END AS changes
FROM n FULL JOIN o ON n.cve_id = o.cve_id""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored against new records by one full outer join, with status and changed fields."""
    rows = vuln_raw(spark, d)
    side = lambda early: rows.where((F.col("collected_at") < ops.ts("1998-06-01")) == F.lit(early)).groupBy("cve_id").agg(F.min_by("vendor", "seq").alias("vendor"), F.min_by("product", "seq").alias("product"), F.max("cvss_score").alias("cvss_score"))
    return ops.field_changes(side(True), side(False), "cve_id", ["vendor", "product", "cvss_score"])


@query("corroboration", sql("SELECT cve_id, count(DISTINCT source_id) AS n_sources FROM vuln_raw GROUP BY cve_id HAVING count(DISTINCT source_id) > 1"))
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Ids that several sources report."""
    return ops.corroborated(vuln_raw(spark, d))


@query("alias_theta_join", sql("""
, notes AS (SELECT DISTINCT product, vendor, ' ' || trim(regexp_replace(lower('seen in ' || product || '; not in x' || vendor), '[^a-z0-9]+', ' ', 'g')) || ' ' AS note FROM vuln_raw),
met AS (SELECT product, vendor, p_name AS name FROM notes JOIN (SELECT DISTINCT p_name FROM part) n ON contains(note, ' ' || lower(n.p_name) || ' '))
SELECT DISTINCT cve_id, name FROM vuln_raw JOIN met USING (product, vendor)"""))
def alias_join(spark: SparkSession, d: str) -> DataFrame:
    """Names in texts at word bounds: distinct texts meet distinct names by words, and records are joined back."""
    note = F.lower(F.concat(F.lit("seen in "), "product", F.lit("; not in x"), "vendor"))
    records = vuln_raw(spark, d).select("cve_id", note.alias("note"))
    names = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lower("p_name").alias("alias")).distinct()
    met = catalogue.word_join(records.select(F.col("note").alias("text")), names).join(ops.small(names), "alias")
    return records.join(ops.small(met.select(F.col("text").alias("note"), "name")), "note").select("cve_id", "name").distinct()


@query("asof_last_run", "SELECT event_id, last_run::DATE::VARCHAR AS last_run FROM events e ASOF LEFT JOIN (SELECT user_id, ts AS last_run FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup')) r ON e.user_id = r.user_id AND e.ts >= r.last_run WHERE event_type <> 'signup'")
def asof_last_run(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its user's last completed run, as of its time."""
    events = table(spark, d, "events")
    runs = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("run_at"))
    return ops.as_of(events.where("event_type <> 'signup'"), runs, "ts", "user_id", "run_at").select("event_id", day("last_run").alias("last_run"))


@query("range_window_join", sql("SELECT vendor, count(*) AS n FROM vuln_raw WHERE collected_at >= (SELECT max(published_at) - INTERVAL 30 DAYS FROM vuln_raw) GROUP BY vendor"))
def range_window(spark: SparkSession, d: str) -> DataFrame:
    """Rows inside a window that another query bounds."""
    rows = vuln_raw(spark, d)
    bound = rows.agg((F.max("published_at") - F.expr("INTERVAL 30 DAYS")).alias("since"))
    return rows.join(F.broadcast(bound), F.col("collected_at") >= F.col("since")).groupBy("vendor").agg(F.count("*").alias("n"))


@query("dedup_merge", sql("SELECT cve_id, min_by(vendor, seq) AS vendor, min_by(product, seq) AS product, min_by(solution, seq) FILTER (WHERE solution IS NOT NULL) AS solution, max(cvss_score) AS cvss_score, min(published_at)::DATE::VARCHAR AS published, list_sort(list(DISTINCT source_id)) AS source_ids, count(*) AS sightings FROM vuln_raw GROUP BY cve_id"))
def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    """One record an id by first filled values, and all its sources."""
    return ops.dedup_merge(vuln_raw(spark, d)).select("cve_id", "vendor", "product", "solution", "cvss_score", day("published_at").alias("published"), "source_ids", "sightings")


@query("priority_merge", sql("SELECT cve_id, min_by(vendor, (source_id % 9, seq)) AS vendor, min_by(product, (source_id % 9, seq)) AS product, min_by(solution, (source_id % 9, seq)) FILTER (WHERE solution IS NOT NULL) AS solution FROM vuln_raw GROUP BY cve_id"))
def priority_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each field from the best-ranked source that has it."""
    return ops.priority_merge(vuln_raw(spark, d), F.col("source_id") % 9)


@query("earliest_date_merge", sql("SELECT cve_id, min(published_at) FILTER (WHERE published_at >= TIMESTAMP '1999-01-01')::DATE::VARCHAR AS published FROM vuln_raw GROUP BY cve_id"))
def earliest_date(spark: SparkSession, d: str) -> DataFrame:
    """The earliest credible publication."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(day(F.min(F.when(F.col("published_at") >= ops.ts("1999-01-01"), F.col("published_at")))).alias("published"))


@query("date_acceptance", sql(f"SELECT seq, cve_id, collected_at >= TIMESTAMP '1999-01-01' AND collected_at <= TIMESTAMP '{NOW}' + INTERVAL 2 DAYS AND collected_at < published_at + INTERVAL 40 DAYS AND NOT (collected_at > published_at + INTERVAL 41 DAYS AND NOT is_new) AS accepted FROM vuln_raw"))
def date_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Whether a new date may replace the old."""
    old, discovered = F.col("published_at") + F.expr("INTERVAL 40 DAYS"), F.col("published_at") + F.expr("INTERVAL 40 DAYS")
    return vuln_raw(spark, d).select("seq", "cve_id", scoring.date_accepted(old, F.col("collected_at"), discovered, ops.ts(NOW), F.col("is_new")).alias("accepted"))


@query("content_hash", sql("SELECT cve_id, sha256(concat_ws('|', min(vendor), coalesce(min(solution), ''), array_to_string(list_sort(list(DISTINCT product)), ';'))) AS content_hash FROM vuln_raw GROUP BY cve_id"))
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """A digest of scalars and sorted lists."""
    body = F.concat_ws("|", F.min("vendor"), F.coalesce(F.min("solution"), F.lit("")), F.array_join(F.array_sort(F.collect_set("product")), ";"))
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.sha2(body, 256).alias("content_hash"))


@query("provenance_pick", sql("SELECT cve_id, max_by(vendor, (cvss_score, seq)) AS vendor, max(cvss_score) AS confidence FROM vuln_raw GROUP BY cve_id"))
def provenance_pick(spark: SparkSession, d: str) -> DataFrame:
    """The value of the highest confidence."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.max_by("vendor", F.struct("cvss_score", "seq")).alias("vendor"), F.max("cvss_score").alias("confidence"))


@query("remediation_state", sql("SELECT cve_id, CASE WHEN count(solution) = count(*) THEN 'available' WHEN count(solution) > 0 THEN 'incomplete' ELSE 'none' END AS state FROM vuln_raw GROUP BY cve_id"))
def remediation_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether all, some or no sightings carry a solution."""
    state = F.when(F.count("solution") == F.count("*"), "available").when(F.count("solution") > 0, "incomplete").otherwise("none")
    return vuln_raw(spark, d).groupBy("cve_id").agg(state.alias("state"))


@query("latest_per_key", sql("SELECT cve_id, max_by(source_name, (collected_at, seq)) AS source_name, max(collected_at)::DATE::VARCHAR AS collected FROM vuln_raw GROUP BY cve_id"))
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The latest sighting of each id."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.max_by("source_name", F.struct("collected_at", "seq")).alias("source_name"), day(F.max("collected_at")).alias("collected"))


@query("slug_names", "SELECT DISTINCT p_name AS name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug_names(spark: SparkSession, d: str) -> DataFrame:
    """Product names as slugs."""
    return table(spark, d, "part").select(F.col("p_name").alias("name"), text.slug(F.col("p_name")).alias("slug")).distinct()


@query("extract_ids", sql("SELECT seq, list_distinct([upper(cve_id)]) || ['CVE-1999-0001'] AS ids FROM vuln_raw"))
def extract_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids of a text in order of sight."""
    note = F.concat(F.lit("see "), "cve_id", F.lit(", also "), F.lower("cve_id"), F.lit(" and cve-1999-0001."))
    return vuln_raw(spark, d).select("seq", text.cve_ids(note).alias("ids"))


@query("resync_tier", sql(f"SELECT seq, CASE WHEN h <= 24 THEN 1 WHEN h <= 168 THEN 2 WHEN h <= 720 THEN 3 ELSE 4 END::INTEGER AS tier FROM (SELECT seq, date_diff('hour', published_at, TIMESTAMP '{NOW}') AS h FROM vuln_raw)"))
def resync_tier(spark: SparkSession, d: str) -> DataFrame:
    """Re-sync tiers by age."""
    hours = F.timestamp_diff("HOUR", F.col("published_at"), ops.ts(NOW)).cast("double")
    return vuln_raw(spark, d).select("seq", scoring.resync_tier(hours).alias("tier"))


@query("weighted_score", "SELECT s_suppkey AS source_id, CASE WHEN s_acctbal > 0 AND s_nationkey > 5 THEN 100 WHEN s_acctbal > 0 THEN 60 WHEN s_nationkey > 5 THEN 40 ELSE 0 END::INTEGER AS score FROM supplier")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """A weighted share of passed checks, of which one is undetermined."""
    checks = [(F.col("s_acctbal") > 0, 3.0), (F.col("s_nationkey") > 5, 2.0), (F.lit(None).cast("boolean"), 4.0)]
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), scoring.weighted(checks).alias("score"))


@query("grouping_sets", sql("SELECT domain, vendor, count(*) AS n, (grouping(domain) * 2 + grouping(vendor))::BIGINT AS level FROM vuln_raw GROUP BY ROLLUP (domain, vendor)"))
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Relational extra: totals by domain and vendor in one pass."""
    return vuln_raw(spark, d).rollup("domain", "vendor").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("tpch_like_q1", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL")
def pricing(spark: SparkSession, d: str) -> DataFrame:
    """Relational extra: the pricing summary."""
    return table(spark, d, "lineitem").where(F.col("l_shipdate") <= ops.ts("2001-06-01")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("sum_qty"), F.count("*").alias("n"))
