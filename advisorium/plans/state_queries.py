"""Queries over merge state, classification, questions, dates and audits."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advisorium.functions import dates, scoring, text
from advisorium.operators import grounding, questions
from advisorium.operators import records as ops
from advisorium.plans.registry import query
from advisorium.sources.tables import NOW, sql, table, vuln_raw

TODAY = dt.date(2001, 8, 1)


@query("question_answer", sql("SELECT cve_id, seq FROM vuln_raw WHERE cvss_score >= 9 AND published_at >= TIMESTAMP '2001-07-02' AND published_at < TIMESTAMP '2001-08-02'"))
def question_answer(spark: SparkSession, d: str) -> DataFrame:
    """A question in words as a filter."""
    return questions.answer(vuln_raw(spark, d), "show all critical vulnerabilities of the last 30 days", TODAY).select("cve_id", "seq")


@query("question_relaxed", sql("SELECT cve_id, seq FROM vuln_raw WHERE cvss_score >= 9 AND published_at >= TIMESTAMP '2001-01-01' AND published_at < TIMESTAMP '2001-08-02'"))
def question_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """no row has the word, so it is dropped and the other criteria stay."""
    return questions.answer(vuln_raw(spark, d), "critical zebrafish this year", TODAY).select("cve_id", "seq")


@query("question_histogram", sql("SELECT vendor, count(*) AS n, count(*) FILTER (WHERE cvss_score >= 9) AS critical FROM vuln_raw WHERE cvss_score >= 8.0 GROUP BY vendor"))
def question_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Q03: counts over all rows of a question's condition, not over a shown sample."""
    found = questions.answer(vuln_raw(spark, d), "vulnerabilities with score above 8.0", TODAY)
    return found.groupBy("vendor").agg(F.count("*").alias("n"), F.count_if(F.col("cvss_score") >= 9).alias("critical"))


@query("date_texts", "SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS iso, o_orderdate::DATE::VARCHAR AS slash, o_orderdate::DATE::VARCHAR AS named FROM orders")
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same day in three notations."""
    names = F.array(*[F.lit(x) for x in {n: name for name, n in reversed(dates.FRENCH_MONTHS.items())}.values()][::-1])
    day, month, year = F.dayofmonth("o_orderdate").cast("string"), F.month("o_orderdate"), F.year("o_orderdate").cast("string")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), dates.iso_day(F.concat(F.lit("on "), F.to_date("o_orderdate").cast("string"))).alias("iso"),
        dates.iso_day(F.concat(F.lit("le "), F.concat_ws("/", day, month.cast("string"), year))).alias("slash"), dates.iso_day(F.concat_ws(" ", day, F.element_at(names, month), year)).alias("named"),
    )


@query("cvss_guard", sql("SELECT seq, CASE WHEN is_new AND solution IS NULL THEN 4.0 WHEN solution IS NULL THEN 3.1 WHEN is_new THEN 4.0 ELSE 3.1 END AS version FROM vuln_raw"))
def cvss_guard(spark: SparkSession, d: str) -> DataFrame:
    """A newer scoring scheme is never replaced by an older or missing one."""
    none, older, newer = (F.lit(Decimal(x)) for x in ("0.0", "3.1", "4.0"))
    old, new = F.when(F.col("is_new"), newer), F.when(F.col("solution").isNull() | ~F.col("is_new"), older)
    kept = F.when(F.coalesce(new, none) >= F.coalesce(old, none), new).otherwise(old)
    return vuln_raw(spark, d).select("seq", kept.alias("version"))


@query("validation_status", sql("SELECT cve_id, CASE WHEN count(DISTINCT source_id) >= 3 AND count(solution) > 0 THEN 'confirmed' WHEN count(DISTINCT source_id) >= 2 THEN 'corroborated' ELSE 'single' END AS status FROM vuln_raw GROUP BY cve_id"))
def validation_status(spark: SparkSession, d: str) -> DataFrame:
    """How well an id is supported."""
    n, solved = F.countDistinct("source_id"), F.count("solution")
    status = F.when((n >= 3) & (solved > 0), "confirmed").when(n >= 2, "corroborated").otherwise("single")
    return vuln_raw(spark, d).groupBy("cve_id").agg(status.alias("status"))


@query("advisory_fanout", sql("SELECT l_orderkey AS advisory, cve_id, count(*) AS n FROM (SELECT *, substring(seq, 1, 12)::BIGINT AS l_orderkey FROM vuln_raw) GROUP BY ALL"))
def advisory_fanout(spark: SparkSession, d: str) -> DataFrame:
    """An advisory's ids as independent records."""
    grouped = vuln_raw(spark, d).groupBy(F.substring("seq", 1, 12).cast("bigint").alias("advisory")).agg(F.collect_list("cve_id").alias("ids"))
    return grouped.select("advisory", F.explode("ids").alias("cve_id")).groupBy("advisory", "cve_id").agg(F.count("*").alias("n"))


@query("isolation_issues", sql("SELECT cve_id, list_sort(list_filter([CASE WHEN count(DISTINCT product) > 2 THEN 'many_products' END, CASE WHEN min(collected_at) < min(published_at) THEN 'early' END, CASE WHEN count(DISTINCT cve_status) > 0 THEN 'revoked' END], lambda x: x IS NOT NULL)) AS issues FROM vuln_raw GROUP BY cve_id"))
def isolation_issues(spark: SparkSession, d: str) -> DataFrame:
    """Marks of suspect records; none is dropped."""
    many, early, revoked = F.size(F.collect_set("product")) > 2, F.min("collected_at") < F.min("published_at"), F.count("cve_status") > 0
    marks = F.array(F.when(many, F.lit("many_products")), F.when(early, F.lit("early")), F.when(revoked, F.lit("revoked")))
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.array_sort(F.filter(marks, lambda x: x.isNotNull())).alias("issues"))


@query("graded_match", sql("SELECT seq, CASE WHEN vendor = 'Brand#11' AND lower(product) LIKE '%blue%' THEN 'high' WHEN vendor = 'Brand#11' THEN 'rejected' WHEN lower(product) LIKE '%blue%' THEN 'possible' END AS grade FROM vuln_raw WHERE vendor = 'Brand#11' OR lower(product) LIKE '%blue%'"))
def graded_match(spark: SparkSession, d: str) -> DataFrame:
    """Structured matches are sure, a vendor alone never is, text alone is possible."""
    vendor, named = F.col("vendor") == "Brand#11", F.lower("product").contains("blue")
    grade = F.when(vendor & named, "high").when(vendor, "rejected").when(named, "possible")
    return vuln_raw(spark, d).where(vendor | named).select("seq", grade.alias("grade"))


@query("portal_decision", "SELECT page_id, CASE WHEN n >= 8 THEN 'flat' WHEN n < 3 THEN 'none' ELSE 'two_level' END AS decision FROM (SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1))) AS n FROM pages)")
def portal_decision(spark: SparkSession, d: str) -> DataFrame:
    """The structure of a listing by its links."""
    from advisorium.functions import urls

    n = F.size(urls.links(F.col("html")))
    return table(spark, d, "pages").select("page_id", F.when(n >= 8, "flat").when(n < 3, "none").otherwise("two_level").alias("decision"))


@query("method_choice", "WITH c AS (SELECT page_id, m AS method, p, CASE m WHEN 'api' THEN length(url) % 90 WHEN 'rss' THEN length(html) % 80 ELSE 40 END AS score FROM pages, (VALUES ('api', 1), ('rss', 2), ('html', 3)) t(m, p)) SELECT page_id, method, score::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (score >= 50) DESC, CASE WHEN score >= 50 THEN p END, score DESC, p) AS k FROM c) WHERE k = 1")
def method_choice(spark: SparkSession, d: str) -> DataFrame:
    """The first collection method that validates, else the best-scored; three candidates a page, compared in place."""
    scores = [("api", F.length("url") % 90), ("rss", F.length("html") % 80), ("html", F.lit(40))]
    rank = lambda p, s: F.struct((s >= 50).alias("ok"), F.when(s >= 50, -p).otherwise(F.lit(-99)).alias("p"), F.when(s < 50, s).otherwise(0).alias("s"), F.lit(-p).alias("q"))
    best = F.array_max(F.array(*[F.struct(rank(p, s).alias("r"), F.lit(m).alias("method"), s.alias("score")) for p, (m, s) in enumerate(scores, 1)]))
    return table(spark, d, "pages").select("page_id", best.alias("b")).select("page_id", "b.method", F.col("b.score").alias("score"))


@query("due_sources", "SELECT user_id, CASE WHEN h < 24 THEN 'wait' WHEN h < 168 THEN 'due' ELSE 'overdue' END AS state FROM (SELECT user_id, date_sub('hour', max(ts), TIMESTAMP '2024-02-01') AS h FROM events GROUP BY user_id)")
def due_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources by how long ago they last ran."""
    hours = F.timestamp_diff("HOUR", F.max("ts"), ops.ts("2024-02-01"))
    return table(spark, d, "events").groupBy("user_id").agg(F.when(hours < 24, "wait").when(hours < 168, "due").otherwise("overdue").alias("state"))


@query("alert_reconciliation", "WITH f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15') AS old, count(*) FILTER (WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15') AS new FROM events GROUP BY user_id) SELECT user_id, CASE WHEN new > 8 THEN 'active' ELSE 'resolved' END AS state FROM f WHERE old > 8 OR new > 8")
def alert_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Alerts that go on or begin are active, those that are gone are resolved."""
    failed = table(spark, d, "events").where("event_type = 'error'")
    alerts = lambda when: failed.where(when).groupBy("user_id").agg(F.count("*").alias("n")).where("n > 8").select("user_id")
    old, new = alerts(F.col("ts") < ops.ts("2024-01-15")), alerts(F.col("ts") >= ops.ts("2024-01-15")).withColumn("now", F.lit(True))
    return old.join(new, "user_id", "full_outer").select("user_id", F.when(F.col("now"), "active").otherwise("resolved").alias("state"))


@query("upsert_by_key", sql("SELECT cve_id, max_by(seq, (collected_at, seq)) AS seq FROM vuln_raw GROUP BY cve_id"))
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The latest whole row of each key."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(F.max_by("seq", F.struct("collected_at", "seq")).alias("seq"))


@query("catalogue_seed", "SELECT coalesce(a.p_name, b.p_name) AS name, CASE WHEN a.p_name IS NULL THEN 'pruned' WHEN b.p_name IS NULL THEN 'added' ELSE 'kept' END AS state FROM (SELECT DISTINCT p_name FROM part WHERE p_size < 10) a FULL JOIN (SELECT DISTINCT p_name FROM part WHERE p_size BETWEEN 5 AND 14) b ON a.p_name = b.p_name")
def catalogue_seed(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue against its stored state: added, kept and pruned entries."""
    part = table(spark, d, "part")
    new = part.where("p_size < 10").select("p_name").distinct().withColumn("a", F.lit(True))
    old = part.where("p_size between 5 and 14").select("p_name").distinct().withColumn("b", F.lit(True))
    state = F.when(F.col("a").isNull(), "pruned").when(F.col("b").isNull(), "added").otherwise("kept")
    return new.join(old, "p_name", "full_outer").select(F.col("p_name").alias("name"), state.alias("state"))


@query("cascade_delete", sql("SELECT cve_id, seq FROM vuln_raw WHERE source_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"))
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows without those of removed sources."""
    gone = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("source_id"))
    return vuln_raw(spark, d).join(ops.small(gone), "source_id", "left_anti").select("cve_id", "seq")


@query("rename_domain", "SELECT p_partkey AS id, CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN 'renamed' ELSE p_type END AS domain FROM part")
def rename_domain(spark: SparkSession, d: str) -> DataFrame:
    """A domain's new name reaches its products."""
    part = table(spark, d, "part")
    old = part.agg(F.min("p_type")).first()[0]
    return part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == old, "renamed").otherwise(F.col("p_type")).alias("domain"))


@query("notification_rows", sql("SELECT cve_id, seq, CASE WHEN is_new THEN 'new' ELSE 'update' END AS kind FROM vuln_raw WHERE published_at BETWEEN TIMESTAMP '2001-07-30' AND TIMESTAMP '2001-08-02'"))
def notification_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows recent enough to notify, and of what kind."""
    recent = F.col("published_at").between(ops.ts(NOW) - F.expr("INTERVAL 2 DAYS"), ops.ts(NOW) + F.expr("INTERVAL 1 DAY"))
    return vuln_raw(spark, d).where(F.coalesce(recent, F.lit(False))).select("cve_id", "seq", F.when(F.col("is_new"), "new").otherwise("update").alias("kind"))


@query("mark_read", sql("SELECT vendor, count(*) FILTER (WHERE is_new AND published_at >= TIMESTAMP '2001-01-01') AS still_new FROM vuln_raw GROUP BY vendor"))
def mark_read(spark: SparkSession, d: str) -> DataFrame:
    """Older rows are marked as read by a conditional update."""
    rows = vuln_raw(spark, d).withColumn("is_new", F.col("is_new") & (F.col("published_at") >= ops.ts("2001-01-01")))
    return rows.groupBy("vendor").agg(F.count_if("is_new").alias("still_new"))


@query("localised_projection", "SELECT doc_id, CASE WHEN lang = 'fr' AND text <> '' THEN 'fr:' || left(text, 40) ELSE left(text, 40) END AS shown FROM documents")
def localised_projection(spark: SparkSession, d: str) -> DataFrame:
    """A translation replaces the original where there is one."""
    original = F.left("text", F.lit(40))
    translated = F.when((F.col("lang") == "fr") & (F.col("text") != ""), F.concat(F.lit("fr:"), original))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(translated, F.lit("")), original).alias("shown"))


@query("neighbour_window", sql("SELECT seq, cve_id, published_at::DATE::VARCHAR AS day FROM vuln_raw"))
def neighbour_window(spark: SparkSession, d: str) -> DataFrame:
    """Of two ids in a text, each with the date that stands between it and the next."""
    note = F.concat(F.col("cve_id"), F.lit(" published on "), F.to_date("published_at").cast("string"), F.lit("; CVE-1999-0001 on 1999-01-02"))
    rows = vuln_raw(spark, d).select("seq", note.alias("note"))
    parts = F.slice(F.split("note", r"CVE-\d{4}-\d+"), 2, 100)
    both = rows.select("seq", F.explode(F.arrays_zip(F.regexp_extract_all("note", F.lit(r"CVE-\d{4}-\d+"), F.lit(0)).alias("cve_id"), parts.alias("after"))).alias("m"))
    return both.select("seq", F.col("m.cve_id").alias("cve_id"), dates.iso_day(F.col("m.after")).alias("day")).where("cve_id <> 'CVE-1999-0001'")


@query("intersect_except", sql("SELECT 'both' AS side, count(*) AS n FROM (SELECT cve_id FROM vuln_raw WHERE is_new INTERSECT SELECT cve_id FROM vuln_raw WHERE NOT is_new) UNION ALL SELECT 'new', count(*) FROM (SELECT cve_id FROM vuln_raw WHERE is_new EXCEPT SELECT cve_id FROM vuln_raw WHERE NOT is_new)"))
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    """Set operations in one aggregation instead of two shuffles of all ids."""
    sides = vuln_raw(spark, d).groupBy("cve_id").agg(F.bool_or("is_new").alias("x"), F.bool_or(~F.col("is_new")).alias("y"))
    counts = sides.agg(F.count_if(F.col("x") & F.col("y")).alias("both"), F.count_if(F.col("x") & ~F.col("y")).alias("new"))
    return counts.select(F.explode(F.array(F.struct(F.lit("both").alias("side"), F.col("both").alias("n")), F.struct(F.lit("new").alias("side"), F.col("new").alias("n")))).alias("e")).select("e.*")


@query("session_windows", "WITH s AS (SELECT user_id, ts, CASE WHEN date_sub('second', lag(ts) OVER w, ts) < 21600 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, count(*) AS n FROM (SELECT user_id, k, count(*) FROM g GROUP BY ALL) GROUP BY user_id")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a source: runs less than six hours apart belong together."""
    events = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("k")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("sliding_windows", "SELECT (DATE '2024-01-01' + k::INTEGER)::VARCHAR AS day, count(e.ts) AS n FROM range(0, 30) r(k) LEFT JOIN events e ON e.ts >= DATE '2024-01-01' + k::INTEGER AND e.ts < DATE '2024-01-01' + k::INTEGER + INTERVAL 3 DAYS GROUP BY 1 HAVING count(e.ts) > 0")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts over three days from each day of the month on."""
    events = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    counted = events.groupBy(F.window("at", "3 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("w.start").cast("string").alias("day"), "n").where("day >= '2024-01-01' and day < '2024-01-31'")


@query("percentile_bands", sql("SELECT vendor, min(cvss_score) AS low, max(cvss_score) AS high, count(*) AS n FROM (SELECT *, ntile(4) OVER (PARTITION BY vendor ORDER BY cvss_score, seq) AS q FROM vuln_raw) WHERE q = 4 GROUP BY vendor"))
def percentile_bands(spark: SparkSession, d: str) -> DataFrame:
    """The top quarter of each vendor's scores."""
    quarter = F.ntile(4).over(Window.partitionBy("vendor").orderBy("cvss_score", "seq"))
    return vuln_raw(spark, d).withColumn("q", quarter).where("q = 4").groupBy("vendor").agg(F.min("cvss_score").alias("low"), F.max("cvss_score").alias("high"), F.count("*").alias("n"))


@query("technical_tokens_kept", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['CWE-' || (o_custkey % 90 + 10)] WHEN 2 THEN ['2.' || o_custkey || '.1'] ELSE list_sort(['CVE-2020-' || (10000 + o_orderkey), 'https://maker.example/' || o_orderkey || '?a=1']) END AS lost FROM orders""")
def technical_tokens_kept(spark: SparkSession, d: str) -> DataFrame:
    """The technical values of a text that its translation lost or altered."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    weakness = F.concat(F.lit("CWE-"), (F.col("o_custkey") % 90 + 10).cast("string"))
    text = lambda cve, url, cwe, version: F.concat(F.lit("Flaw "), cve, F.lit(" (see "), url, F.lit(") of kind "), cwe, F.lit(" before "), version)
    cve, url, version = F.concat(F.lit("CVE-2020-"), (10000 + F.col("o_orderkey")).cast("string")), F.concat(F.lit("https://maker.example/"), k, F.lit("?a=1")), F.concat(F.lit("2."), c, F.lit(".1"))
    case, said = F.col("o_orderkey") % 4, text(cve, url, weakness, version)
    kept = F.when(case == 0, F.lower(said)).when(case == 1, text(cve, url, F.lit("CWE-9"), version)).when(case == 2, text(cve, url, weakness, F.concat(F.lit("2."), c, F.lit(".2")))).otherwise(text(F.lit("CVE-2020-9999"), F.concat(F.lit("https://maker.example/"), k), weakness, version))
    return table(spark, d, "orders").select("o_orderkey", grounding.missing_values(said, kept).alias("lost"))


@query("completeness_rows", sql("SELECT seq, round_even((2 + CASE WHEN solution <> '' THEN 1 ELSE 0 END + CASE WHEN cve_status <> '' THEN 1 ELSE 0 END) * 100 / 4, 0)::INTEGER AS filled FROM vuln_raw"))
def completeness_rows(spark: SparkSession, d: str) -> DataFrame:
    """The share of filled fields by row."""
    return vuln_raw(spark, d).select("seq", scoring.completeness([F.col(c) for c in ("vendor", "product", "solution", "cve_status")]).alias("filled"))


@query("qualifier_names", "SELECT DISTINCT p_name || ' (beta)' AS raw, p_name AS name FROM part")
def qualifier_names(spark: SparkSession, d: str) -> DataFrame:
    """Names without parenthesised parts."""
    raw = F.concat("p_name", F.lit(" (beta)"))
    return table(spark, d, "part").select(raw.alias("raw"), text.strip_qualifier(raw).alias("name")).distinct()
