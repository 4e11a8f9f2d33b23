"""Queries that meet records with the catalogue of products, and names with names that they resemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.functions import official, urls
from advisorium.functions.columns import spread
from advisorium.operators import catalogue, similarity
from advisorium.plans.page_queries import joined
from advisorium.plans.registry import query
from advisorium.plans.text_queries import HOST
from advisorium.sources.tables import table


@query("near_labels", f"""
WITH l AS (SELECT DISTINCT string_split({HOST}, '.')[1] AS label FROM pages), n AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS target FROM part UNION SELECT DISTINCT string_split({HOST}, '.')[1] FROM pages)
SELECT label, target, CASE WHEN levenshtein(label, target) BETWEEN 1 AND CASE WHEN length(target) <= 6 THEN 1 ELSE 2 END THEN levenshtein(label, target) ELSE 0 END AS distance FROM l JOIN n
ON length(target) >= 4 AND label <> target AND (levenshtein(label, target) <= CASE WHEN length(target) <= 6 THEN 1 ELSE 2 END OR contains(label, target))""")
def near_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of hosts with the names that they resemble, other labels among them, by what is left when letters are taken out."""
    labels = table(spark, d, "pages").select(F.substring_index(urls.host(F.col("url")), ".", 1).alias("label")).where("label is not null")
    names = table(spark, d, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("target")).unionAll(labels)
    return similarity.near_names(labels, names, "label").select(F.col("name").alias("label"), "target", "distance")


@query("typosquat", f"SELECT DISTINCT label, n_name AS near FROM (SELECT string_split({HOST}, '.')[1] AS label FROM pages) JOIN (SELECT lower(n_name) AS n_name FROM nation) ON levenshtein(label, n_name) <= 2 AND label <> n_name")
def typosquat(spark: SparkSession, d: str) -> DataFrame:
    """First host labels within two edits of a known name."""
    labels = table(spark, d, "pages").select(F.substring_index(urls.host(F.col("url")), ".", 1).alias("name")).where("name is not null").distinct()
    names = table(spark, d, "nation").select(F.lower("n_name").alias("target")).distinct()
    return similarity.within_edits(labels, names, F.lit(2), 2).select(F.col("name").alias("label"), F.col("target").alias("near"))


@query("typosquat_hosts", """
WITH o AS (SELECT 'maker' || n_nationkey || 'house.org' AS domain, 'maker' || n_nationkey || 'house' AS label, n_nationkey AS position FROM nation),
h AS (SELECT DISTINCT label || suffix AS host, label FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'maker' || c_nationkey || 'house' WHEN 1 THEN 'maker' || c_nationkey || 'hose' WHEN 2 THEN 'my-maker' || c_nationkey || 'house-x' ELSE 'moker' || c_nationkey || 'houze' END AS label,
  CASE c_custkey % 3 WHEN 0 THEN '.org' WHEN 1 THEN '.com' ELSE '.gov' END AS suffix FROM customer)),
m AS (SELECT host, domain AS imitates, position, levenshtein(h.label, o.label) AS far, contains(h.label, o.label) AS within FROM h JOIN o ON h.label <> o.label AND (levenshtein(h.label, o.label) <= 2 OR contains(h.label, o.label)) WHERE host NOT LIKE '%.gov' AND host NOT IN (SELECT domain FROM o))
SELECT host, arg_min(imitates, position) AS imitates, arg_min(CASE WHEN far <= 2 THEN far ELSE 0 END, position) AS distance FROM m GROUP BY host""")
def typosquat_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that read like official domains, governments and the domains themselves left out."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    label = F.when(k % 4 == 0, joined("maker", n, "house")).when(k % 4 == 1, joined("maker", n, "hose")).when(k % 4 == 2, joined("my-maker", n, "house-x")).otherwise(joined("moker", n, "houze"))
    hosts = table(spark, d, "customer").select(F.concat(label, F.element_at(F.array(F.lit(".org"), F.lit(".com"), F.lit(".gov")), (k % 3 + 1).cast("int"))).alias("host"))
    official = table(spark, d, "nation").select(joined("maker", F.col("n_nationkey"), "house.org").alias("domain"), F.col("n_nationkey").alias("position"))
    return similarity.typosquats(hosts, official)


CPE_SQL = "'cpe:2.3:a:' || lower(replace(p_brand, '#', '')) || ':' || replace(p_name, ' ', '_') || ':' || p_size || ':*'"
WANT_SQL = "SELECT CASE n_nationkey % 4 WHEN 0 THEN 'cpe:2.3:a:brand' || (n_nationkey + 1) || ':s' WHEN 1 THEN 'brand' || n_nationkey WHEN 2 THEN '_bolt:' || n_nationkey || ':*' ELSE 'a:brand' || n_nationkey || ':' END AS want FROM nation"


def _cpe():
    return F.concat(F.lit("cpe:2.3:a:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(":"), F.col("p_size").cast("string"), F.lit(":*"))


@query("cpe_containment", f"SELECT want, count(*) AS n FROM (SELECT p_partkey, {CPE_SQL} AS cpe FROM part) JOIN ({WANT_SQL}) ON contains(cpe, want) GROUP BY want")
def cpe_containment(spark: SparkSession, d: str) -> DataFrame:
    """Records by the catalogue's CPEs that their own start with or hold, by runs of whole parts."""
    records = table(spark, d, "part").select("p_partkey", _cpe().alias("cpe"))
    n = F.col("n_nationkey")
    want = F.when(n % 4 == 0, joined("cpe:2.3:a:brand", n + 1, ":s")).when(n % 4 == 1, joined("brand", n)).when(n % 4 == 2, joined("_bolt:", n, ":*")).otherwise(joined("a:brand", n, ":"))
    met = catalogue.cpe_join(records, table(spark, d, "nation").select(want.alias("want")))
    return records.join(met, "cpe").groupBy("want").agg(F.count("*").alias("n"))


def products(spark: SparkSession, d: str) -> DataFrame:
    """A product for each name of a part, with aliases, keywords and CPEs where its first part has them, and the domains' state."""
    first = table(spark, d, "part").groupBy("p_name").agg(F.min(F.struct("p_partkey", "p_brand", "p_type", "p_size")).alias("f"))
    k = F.col("f.p_partkey")
    none = F.array().cast("array<string>")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    rows = first.select(
        F.col("p_name").alias("name"), F.col("f.p_brand").alias("vendor"), F.col("f.p_type").alias("domain"), F.when(k % 2 == 1, F.array(F.concat_ws(" ", "p_name", F.col("f.p_size").cast("string")), F.lit(""))).alias("aliases"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("Flaw in "), word))).otherwise(none).alias("keywords"), F.when(k % 4 == 0, F.array(F.concat(F.lit("CPE:2.3:a:"), F.lower(F.replace("f.p_brand", F.lit("#"), F.lit(""))), F.lit(":"), word))).alias("cpes"),
        (k % 11 != 5).alias("enabled"), k.alias("position"),
    )
    domains = rows.select(F.col("domain").alias("name"), (F.col("domain") != "PROMO").alias("enabled")).distinct()
    return catalogue.compiled(rows, domains)


PRODUCTS_SQL = """f AS (SELECT p_name AS name, arg_min(p_brand, p_partkey) AS vendor, arg_min(p_type, p_partkey) AS domain, arg_min(p_size, p_partkey) AS size, min(p_partkey) AS k FROM part GROUP BY p_name),
c AS (SELECT name, vendor, domain, k AS position, lower(vendor) AS brand,
  list_distinct([lower(name), lower(vendor || ' ' || name)] || CASE WHEN k % 2 = 1 THEN [lower(name || ' ' || size)] ELSE [] END || CASE WHEN k % 3 = 0 THEN ['flaw in ' || split_part(name, ' ', 1)] ELSE [] END) AS broad,
  CASE WHEN k % 3 = 0 THEN ['flaw in ' || split_part(name, ' ', 1)] WHEN k % 2 = 1 THEN [lower(name || ' ' || size)] ELSE [lower(name)] END AS strict,
  CASE WHEN k % 4 = 0 THEN ['cpe:2.3:a:' || lower(replace(vendor, '#', '')) || ':' || split_part(name, ' ', 1)] ELSE [] END AS cpes FROM f WHERE k % 11 <> 5 AND domain <> 'PROMO')"""


@query("catalogue_compiled", f"WITH {PRODUCTS_SQL} SELECT name, vendor, domain, list_sort(broad) AS broad, strict, cpes FROM c")
def catalogue_compiled(spark: SparkSession, d: str) -> DataFrame:
    """The active catalogue with the aliases that tell products in structured and in free text."""
    return products(spark, d).select("name", "vendor", "domain", F.array_sort("broad").alias("broad"), "strict", "cpes")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records of parts: some with a CPE, some with a vendor and a product, some with a vendor alone, some with free text only."""
    k = F.col("p_partkey")
    structured = F.when(k % 4 == 1, "").when(k % 4 == 2, F.lower(F.concat(F.col("p_brand"), F.lit(" ; thing")))).otherwise(F.lower(F.concat_ws(" ; ", "p_brand", "p_name")))
    cpes = catalogue.cpe_list([F.when(k % 5 == 0, _cpe())], [F.when(k % 7 == 0, F.array(_cpe(), F.lit("cpe:2.3:o:x:y:1")))])
    free = F.concat(F.lit("A flaw in "), "p_name", F.lit(" "), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", cpes.alias("cpes"), structured.alias("structured"), free.alias("free"))


RECORDS_SQL = f"""r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN [{CPE_SQL}] ELSE [] END AS cpes,
  CASE p_partkey % 4 WHEN 1 THEN '' WHEN 2 THEN lower(p_brand || ' ; thing') ELSE lower(p_brand || ' ; ' || p_name) END AS structured, lower('A flaw in ' || p_name || ' ' || p_size) AS free FROM part),
e AS (SELECT cpes, structured, free, ' ' || regexp_replace(structured, '[^a-z0-9]+', ' ', 'g') || ' ' AS st, ' ' || regexp_replace(free, '[^a-z0-9]+', ' ', 'g') || ' ' AS ft FROM (SELECT DISTINCT cpes, structured, free FROM r)),
m AS (SELECT e.*, c.*, len(list_filter(e.cpes, lambda x: len(list_filter(c.cpes, lambda w: contains(x, w))) > 0)) > 0 AS by_cpe,
  len(list_filter(c.broad, lambda a: contains(st, ' ' || trim(regexp_replace(a, '[^a-z0-9]+', ' ', 'g')) || ' '))) > 0 AS by_broad,
  len(list_filter(c.strict, lambda a: contains(ft, ' ' || trim(regexp_replace(a, '[^a-z0-9]+', ' ', 'g')) || ' '))) > 0 AS by_strict FROM e, c)"""


@query("catalogue_grades", f"""WITH {PRODUCTS_SQL}, {RECORDS_SQL},
g AS (SELECT cpes, structured, free, name, domain, CASE WHEN by_cpe THEN 'confirmed' WHEN structured <> '' AND by_broad THEN 'high_confidence' WHEN structured = '' AND by_strict THEN 'possible' END AS grade FROM m)
SELECT p_partkey, name AS product, domain, grade FROM r JOIN g ON r.structured = g.structured AND r.free = g.free AND r.cpes = g.cpes WHERE grade IS NOT NULL""")
def catalogue_grades(spark: SparkSession, d: str) -> DataFrame:
    """Records graded against the whole catalogue, by CPEs, specific aliases and free text."""
    return catalogue.graded(records(spark, d), products(spark, d)).select("p_partkey", "product", "domain", "grade")


@query("catalogue_matches", f"""WITH {PRODUCTS_SQL}, {RECORDS_SQL},
h AS (SELECT cpes, structured, free, name, domain, position, CASE WHEN by_cpe THEN 0 WHEN structured <> '' AND by_broad THEN 1 WHEN structured = '' AND by_strict AND NOT bool_or(by_cpe) OVER (PARTITION BY cpes, structured, free) THEN 2 END AS rank FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY cpes, structured, free ORDER BY rank, position) = 1 AS is_primary FROM h WHERE rank IS NOT NULL)
SELECT p_partkey, name AS product, domain, is_primary FROM r JOIN p ON r.structured = p.structured AND r.free = p.free AND r.cpes = p.cpes""")
def catalogue_matches(spark: SparkSession, d: str) -> DataFrame:
    """Records matched by the older rule, CPE matches added, with the primary product of each."""
    return catalogue.matched(records(spark, d), products(spark, d)).select("p_partkey", "product", "domain", "is_primary")


@query("official_sources", """
WITH c AS (SELECT c_custkey AS k, 'maker' || c_nationkey AS maker, 'CVE-2020-' || (10000 + c_custkey) AS cve FROM customer)
SELECT k AS c_custkey, list_sort([maker || 'labs', maker || '-labs', maker] || CASE WHEN k % 3 = 0 THEN ['firefox', 'mozilla'] ELSE [] END) AS slugs,
  CASE k % 5 WHEN 0 THEN 'https://www.' || maker || '.com/security/' || k WHEN 1 THEN 'https://github.com/' || maker || '/x' WHEN 2 THEN 'https://nvd.nist.gov/vuln/detail/' || cve WHEN 3 THEN 'https://www.cve.org/CVERecord?id=' || cve ELSE 'https://support.' || maker || '.com/a' END AS source,
  CASE k % 5 WHEN 0 THEN 'https://www.' || maker || '.com/security/' || k WHEN 1 THEN 'https://github.com/' || maker || '/x' WHEN 4 THEN 'https://support.' || maker || '.com/a' END AS site FROM c""")
def official_sources(spark: SparkSession, d: str) -> DataFrame:
    """Names of vendors in hosts, and the official source and site that they tell among references."""
    k, maker = F.col("c_custkey"), joined("maker", F.col("c_nationkey"))
    cve = joined("CVE-2020-", 10000 + k)
    blog, other, nvd = joined("https://blog.example/", cve), joined("https://", maker, ".com/CVE-2020-", 10001 + k), joined("https://nvd.nist.gov/vuln/detail/", cve)
    refs = (
        F.when(k % 5 == 0, F.array(joined("https://", maker, ".com/home"), joined("https://bugs.", maker, ".com/security/1"), joined("https://www.", maker, ".com/security/", k), nvd))
        .when(k % 5 == 1, F.array(blog, nvd, joined("https://github.com/other/", maker), joined("https://github.com/", maker, "/x")))
        .when(k % 5 == 2, F.array(blog, joined("https://www.cisa.gov/x"), nvd, other)).when(k % 5 == 3, F.array(blog, nvd)).otherwise(F.array(nvd, joined("https://support.", maker, ".com/a"), F.lit("ftp://x")))
    )
    slugs = official.vendor_slugs(F.concat(maker, F.lit(" Labs Inc.")), F.when(k % 3 == 0, F.array(F.lit("Linux Firefox"), F.lit("NVD - CVE-2020-0001"))))
    rows = spread(table(spark, d, "customer"), "c_custkey").select("c_custkey", refs.alias("refs"), cve.alias("cve"), maker.alias("vendor"), F.filter(slugs, lambda s: ~s.contains("inc")).alias("own"), F.when(k % 5 == 3, joined(nvd, "/")).alias("collected"))
    own = F.concat(F.col("own"), F.array(F.concat("vendor", F.lit("labs")), F.concat("vendor", F.lit("-labs"))))
    told = rows.withColumn("slugs", F.array_sort(F.array_distinct(own)))
    return told.select("c_custkey", "slugs", official.official_source(F.col("refs"), F.col("slugs"), F.col("cve"), F.col("collected")).alias("source"), official.official_site(F.when(F.col("c_custkey") % 5 == 2, F.slice("refs", 1, 3)).otherwise(F.col("refs")), F.col("slugs"), F.col("vendor")).alias("site"))


@query("vendor_sites", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://maker' || c_nationkey || '.com/' WHEN 1 THEN 'https://a.maker' || c_nationkey || '.org/' END AS site FROM customer")
def vendor_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites of vendors that are called by their domains."""
    k, n = F.col("c_custkey") % 3, F.col("c_nationkey")
    vendor = F.when(k == 0, joined(" Maker", n, ".COM/ ")).when(k == 1, joined("https://A.maker", n, ".org/x")).otherwise(joined("Maker ", n, " Inc."))
    return table(spark, d, "customer").select("c_custkey", official.vendor_site(vendor).alias("site"))
