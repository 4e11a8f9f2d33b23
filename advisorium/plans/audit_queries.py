"""Queries that audit and repair collections of records, and check written texts against what they were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.functions.columns import spread
from advisorium.operators import audits, catalogue, grounding
from advisorium.plans.page_queries import joined
from advisorium.plans.registry import query
from advisorium.sources.tables import table


def audited_records(spark: SparkSession, d: str) -> DataFrame:
    """A record for each customer, with faults of its own by its key: frame references, copied dates, unusable and marked-up texts, foreign sources."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    cve = joined("CVE-2020-", 10000 + k)
    refs = F.when(k % 5 == 0, F.array(F.lit("https://fonts.googleapis.com/css"), joined("https://maker", n, ".example/advisory/", k))).otherwise(F.array(joined("https://maker", n, ".example/advisory/", k)))
    day = F.date_add(F.lit("2020-01-01").cast("date"), n).cast("timestamp_ntz")
    told = joined("A flaw in boxes of maker ", n, " lets someone who is near read what customer ", k, " keeps")
    description = F.when(k % 7 == 0, joined("function(", k, "){ return display:none }; some code that was taken for a text")).when(k % 7 == 1, joined("<p>", told, "</p>")).when(k % 7 == 2, joined("** REJECTED ** Rejected reason: a copy of ", k, " was told apart")).when(k % 7 == 3, F.lit(None).cast("string")).when(k % 7 == 4, "too short").otherwise(told)
    solution = F.when(k % 6 == 0, joined("Update boxes&nbsp;to version 1.", k)).when(k % 6 == 1, "Sign in").otherwise(joined("Update boxes to version 1.", k))
    source = F.when(k % 4 == 0, joined("https://maker.example/CVE-2020-", 10001 + k)).when(k % 4 == 1, joined("https://maker.example/", F.lower(cve))).otherwise(joined("https://maker.example/", k))
    return spread(table(spark, d, "customer"), "c_custkey").select(
        cve.alias("cve_id"), refs.alias("references"), day.alias("published_at"), F.when(k % 3 == 0, day).when(k % 3 == 1, F.timestamp_add("DAY", F.lit(1), day)).alias("advisory_published_at"), description.alias("description"), solution.alias("solution"),
        source.alias("official_source_url"), F.lit("verified").alias("validation_status"), F.lit(None).cast("string").alias("cve_status"), k.alias("c_custkey"),
    )


@query("audit_faults", """
SELECT unnest(['A_frame_references', 'B_advisory_date_as_publication', 'C_unusable_description', 'D_unusable_solution', 'E_foreign_official_source', 'F_marked_up_text', 'G_revoked_record']) AS rule,
  unnest([count(*) FILTER (c_custkey % 5 = 0), count(*) FILTER (c_custkey % 3 = 0), count(*) FILTER (c_custkey % 7 IN (0, 4)), count(*) FILTER (c_custkey % 6 = 1), count(*) FILTER (c_custkey % 4 = 0),
    count(*) FILTER (c_custkey % 7 = 1 OR c_custkey % 6 = 0), count(*) FILTER (c_custkey % 7 = 2)]) AS n, count(*) AS records FROM customer""")
def audit_faults(spark: SparkSession, d: str) -> DataFrame:
    """How many records break each of the seven rules."""
    return audits.fault_counts(audited_records(spark, d))


@query("audit_repairs", """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, 'A flaw in boxes of maker ' || c_nationkey || ' lets someone who is near read what customer ' || c_custkey || ' keeps' AS told FROM customer)
SELECT 'CVE-2020-' || (10000 + k) AS cve_id, ['https://maker' || n || '.example/advisory/' || k] AS refs, CASE WHEN k % 3 <> 0 THEN (DATE '2020-01-01' + n)::VARCHAR END AS published, CASE WHEN k % 3 = 0 THEN 'insufficient_data' ELSE 'verified' END AS validation_status,
  CASE WHEN k % 7 IN (1, 5, 6) THEN told WHEN k % 7 = 2 THEN '** REJECTED ** Rejected reason: a copy of ' || k || ' was told apart' END AS description, CASE WHEN k % 6 <> 1 THEN 'Update boxes to version 1.' || k END AS solution,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://maker.example/cve-2020-' || (10000 + k) ELSE 'https://maker.example/' || k END AS official_source_url, CASE WHEN k % 7 = 2 THEN 'rejected' END AS cve_status FROM c""")
def audit_repairs(spark: SparkSession, d: str) -> DataFrame:
    """The same records with every fault mended in one pass."""
    mended = audits.repaired(audited_records(spark, d))
    return mended.select("cve_id", F.col("references").alias("refs"), F.date_format("published_at", "yyyy-MM-dd").alias("published"), "validation_status", "description", "solution", "official_source_url", "cve_status")


@query("audit_after_repair", "SELECT 'G_revoked_record' AS rule, count(*) FILTER (c_custkey % 7 = 2) AS n, count(*) AS records FROM customer")
def audit_after_repair(spark: SparkSession, d: str) -> DataFrame:
    """The audit once more after the repair; what was revoked stays named so, nothing else is left."""
    left = audits.fault_counts(audits.repaired(audited_records(spark, d)).drop("faults"))
    return left.where("n > 0")


def copied_records(spark: SparkSession, d: str) -> DataFrame:
    """A record for each customer: texts of every second one name another vendor, as copied from an advisory of many."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    brand = lambda x: joined("brand", F.lpad(x.cast("string"), 2, "0"))
    named = F.when(k % 2 == 1, (n + 1) % 25).otherwise(n)
    empty = F.array().cast("array<string>")
    return table(spark, d, "customer").select(
        joined("CVE-2021-", 10000 + k).alias("cve_id"), F.when(k % 9 == 8, F.lit(None).cast("string")).otherwise(F.concat(brand(n), F.lit(" Inc"))).alias("vendor"), F.when(k % 3 == 0, F.concat(brand(n), F.lit(" Suite"))).otherwise("other thing").alias("product"),
        F.lit(None).cast("array<string>").alias("affected_products"), F.array(F.concat(brand(named), F.lit(" OS")), F.when(k % 4 == 0, "any system").otherwise("all systems")).alias("affected_systems"),
        F.concat(F.lit("Élévation de privileges in "), F.upper(brand(named)), F.lit(" boxes")).alias("impact"), F.lit("Apply the update").alias("solution"), F.lit("t").alias("title"), F.lit("d").alias("description"), empty.alias("cpes"),
        F.when(k % 2 == 0, F.array(F.lit("old product"))).alias("monitored_products"), F.array(F.lit("old")).alias("domains"), F.lit("old product").alias("monitored_product"), F.lit("old").alias("domain"), F.lit(None).cast("string").alias("match_confidence"), F.lit(None).cast("string").alias("match_evidence"),
        F.when(k % 10 == 3, F.array(F.lit("impact"))).alias("verified"), F.when(k % 13 == 12, "rejected").alias("cve_status"), k.alias("k"), n.alias("n"),
    )


COPIED_SQL = """c AS (SELECT c_custkey AS k, c_nationkey AS n, 'CVE-2021-' || (10000 + c_custkey) AS cve_id, c_custkey % 2 = 1 AND c_custkey % 9 <> 8 AND c_custkey % 13 <> 12 AS strange FROM customer),
known AS (SELECT DISTINCT n FROM c WHERE k % 9 <> 8 AND k % 13 <> 12),
s AS (SELECT cve_id, k, (n + 1) % 25 AS named, k % 4 = 0 AS any_system FROM c WHERE strange AND (n + 1) % 25 IN (SELECT n FROM known)),
x AS (SELECT cve_id, 'impact' AS field, named::VARCHAR AS value, k % 10 = 3 AS protected FROM s UNION ALL SELECT cve_id, 'affected_systems', named || '|' || any_system, false FROM s),
bad AS (SELECT cve_id, field, protected FROM x JOIN (SELECT field, value FROM x GROUP BY ALL HAVING count(*) >= 3) USING (field, value))"""


@query("contaminated_values", f"WITH {COPIED_SQL} SELECT * FROM bad")
def contaminated_values(spark: SparkSession, d: str) -> DataFrame:
    """Values that records of one vendor share and that name another one, with the protection of verified fields."""
    return audits.contaminated(copied_records(spark, d)).select("cve_id", "field", "protected")


def suites(spark: SparkSession, d: str) -> DataFrame:
    """A product of each nation's brand."""
    brand = joined("brand", F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    none = F.array().cast("array<string>")
    rows = table(spark, d, "nation").select(F.concat(brand, F.lit(" Suite")).alias("name"), brand.alias("vendor"), joined("domain ", F.col("n_regionkey")).alias("domain"), F.array(brand).alias("aliases"), none.alias("keywords"), none.alias("cpes"), F.lit(True).alias("enabled"), F.col("n_nationkey").alias("position"))
    return catalogue.compiled(rows, rows.select(F.col("domain").alias("name"), F.lit(True).alias("enabled")).distinct())


@query("isolation_repairs", f"""WITH {COPIED_SQL}, e AS (SELECT cve_id, list_sort(list(field)) AS emptied FROM bad WHERE NOT protected GROUP BY cve_id)
SELECT c.cve_id, coalesce(emptied, []) AS emptied, CASE WHEN k % 13 = 12 THEN CASE WHEN k % 2 = 0 THEN ['old product'] END WHEN k % 3 = 0 THEN ['brand' || lpad(n::VARCHAR, 2, '0') || ' Suite'] WHEN k % 2 = 0 THEN [] END AS monitored_products,
  CASE WHEN k % 13 = 12 OR (k % 3 <> 0 AND k % 2 = 1) THEN NULL WHEN k % 3 = 0 THEN 'high_confidence' ELSE 'rejected' END AS match_confidence, CASE WHEN k % 13 = 12 OR (k % 3 <> 0 AND k % 2 = 1) THEN 'old' WHEN k % 3 = 0 THEN 'domain ' || n_regionkey END AS domain,
  k % 13 <> 12 AND (k % 3 = 0 OR k % 2 = 0) AS rescoped
FROM c LEFT JOIN e ON c.cve_id = e.cve_id JOIN nation ON n = n_nationkey""")
def isolation_repairs(spark: SparkSession, d: str) -> DataFrame:
    """The records without copied values and with their scope told anew."""
    return audits.isolated(copied_records(spark, d), suites(spark, d)).select("cve_id", "emptied", "monitored_products", "match_confidence", "domain", "rescoped")


@query("isolation_second_run", "SELECT 0::BIGINT AS emptied, 0::BIGINT AS rescoped, count(*) AS records FROM customer")
def isolation_second_run(spark: SparkSession, d: str) -> DataFrame:
    """A second run over what the first one gave; it finds nothing to do."""
    first = audits.isolated(copied_records(spark, d), suites(spark, d)).drop("emptied", "rescoped")
    return audits.isolated(first, suites(spark, d)).agg(F.count_if(F.size("emptied") > 0).alias("emptied"), F.count_if("rescoped").alias("rescoped"), F.count("*").alias("records"))


def read_pages(spark: SparkSession, d: str) -> DataFrame:
    """Two pages that were read for each customer but every eleventh, with versions, ids and urls of its own."""
    k = F.col("c_custkey")
    rows = spread(table(spark, d, "customer"), "c_custkey").where(k % 11 != 10).select(k.alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("p"))
    page = F.when(F.col("p") == 1, joined("Boxes before 2.", F.col("id"), ".1 fall to CVE-2022-", 10000 + F.col("id"), " (CWE-79).")).otherwise(joined("Update to 3.", F.col("id"), " from https://maker.example/get/", F.col("id"), "?v=1"))
    return rows.select("id", joined("https://page", F.col("p"), ".example/", F.col("id")).alias("url"), joined("Page ", F.col("p")).alias("name"), page.alias("page"))


@query("grounded_drafts", """
WITH c AS (SELECT c_custkey AS k, c_custkey % 11 <> 10 AS has_pages FROM customer),
s AS (SELECT k, has_pages, CASE WHEN has_pages AND k % 5 NOT IN (1, 4) THEN 'Boxes under 2.' || k || '.1 have CVE-2022-' || (10000 + k) END AS summary, has_pages AND k % 4 NOT IN (1, 2) AND k % 5 <> 4 AS solved FROM c)
SELECT k AS id, summary, CASE WHEN solved THEN 'Go to 3.' || k END AS solution, CASE WHEN solved THEN 'https://page2.example/' || k END AS solution_url, CASE WHEN solved THEN 'Page 2' END AS solution_name,
  CASE WHEN summary IS NOT NULL OR solved THEN 'completed' WHEN has_pages AND k % 5 = 4 THEN 'failed' ELSE 'insufficient' END AS status FROM s""")
def grounded_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Summaries and solutions whose technical values the pages that were read bear out; others are dropped."""
    k = F.col("c_custkey")
    summary = F.when(k % 5 == 4, "  ").when(k % 5 == 1, joined("Boxes under 9.", k, ".1 have CVE-2022-", 10000 + k)).otherwise(joined("Boxes under 2.", k, ".1 have CVE-2022-", 10000 + k))
    solution = F.when(k % 5 == 4, F.lit(None).cast("string")).when(k % 4 == 1, joined("Go to 7.", k)).otherwise(joined("Go to 3.", k))
    url = F.when(k % 5 == 4, F.lit(None).cast("string")).when(k % 4 == 2, joined("https://elsewhere.example/", k)).otherwise(joined("https://page2.example/", k))
    drafts = spread(table(spark, d, "customer"), "c_custkey").select(k.alias("id"), summary.alias("summary"), solution.alias("solution"), url.alias("url"))
    return grounding.grounded(drafts, read_pages(spark, d))


@query("invented_values", "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 10 THEN list_sort(['1.' || c_custkey, 'CVE-2022-' || (10000 + c_custkey)]) WHEN c_custkey % 3 = 0 THEN ['1.' || c_custkey] ELSE [] END AS invented FROM customer")
def invented_values(spark: SparkSession, d: str) -> DataFrame:
    """Technical values of a text that stand on none of its own pages, whole or within longer ones."""
    k = F.col("c_custkey")
    version = F.when((k % 3 == 0) | (k % 11 == 10), joined("1.", k)).otherwise(joined("2.", k, ".1"))
    said = joined("See cve CVE-2022-", 10000 + k, " under ", version)
    texts = spread(table(spark, d, "customer"), "c_custkey").select(k.alias("id"), F.lit("text").alias("field"), said.alias("said"))
    return grounding.ungrounded(texts, read_pages(spark, d)).select("id", "invented")


@query("accepted_translations", """
WITH o AS (SELECT o_orderkey AS k, 'Orders of 1.' || o_custkey || ' break' AS title, 'See https://maker.example/' || o_orderkey || ' and CWE-' || (o_custkey % 90 + 10) AS impact FROM orders),
t AS (SELECT k, CASE WHEN k % 4 IN (0, 1) THEN 'Commandes 1.' || split_part(split_part(title, '1.', 2), ' ', 1) END AS title_fr, CASE WHEN k % 4 = 0 OR k % 4 = 2 THEN 'Voir ' || lower(impact) END AS impact_fr, title, impact FROM o)
SELECT k AS id, title_fr, impact_fr, CASE WHEN k % 4 = 3 THEN CASE WHEN k % 8 = 7 THEN 'not_required' ELSE 'failed' END ELSE 'completed' END AS status, CASE k % 4 WHEN 0 THEN ['impact', 'title'] WHEN 1 THEN ['title'] WHEN 2 THEN ['impact'] ELSE [] END AS kept,
  CASE WHEN k % 4 = 1 THEN 'impact (' || split_part(impact, ' and ', 2) || ')' WHEN k % 4 = 2 THEN 'title (1.' || split_part(split_part(title, '1.', 2), ' ', 1) || ')' END AS warning FROM t""")
def accepted_translations(spark: SparkSession, d: str) -> DataFrame:
    """Translations field by field, accepted where they keep all technical values of their source."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("string")
    title, impact = joined("Orders of 1.", c, " break"), joined("See https://maker.example/", k, " and CWE-", c % 90 + 10)
    rows = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 8 == 7, none).otherwise(title).alias("title"), F.when(k % 8 == 7, " ").otherwise(impact).alias("impact"),
        F.when(k % 4 == 3, none).when(k % 4 == 2, joined("Commandes 2.", c + 1)).otherwise(joined(" Commandes 1.", c, " ")).alias("title_fr"),
        F.when(k % 4 == 3, none).when(k % 4 == 1, joined("Voir https://maker.example/", k)).otherwise(F.concat(F.lit("Voir "), F.lower(impact))).alias("impact_fr"),
    )
    return grounding.accepted_translations(rows, ["title", "impact"])
