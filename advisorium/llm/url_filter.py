"""Operator 1, URL filters: block and allow rules matched by host-suffix and path-prefix expressions.

Every url is expanded into its host suffixes times its path prefixes, as far as the rules go in labels and
folders. Expressions meet rules by an equi-join on the first 32 bits of their SHA-256, the whole digest
then confirms a match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm.common import lower_ascii, table

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rules up to this many are broadcast (their counted number, under 200 bytes each); more are joined by shuffle.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per input row: the columns in keep, then host, path, rule and verdict.

    rules has verdict (allow or block), host and path; a path starts and ends with a slash (else ValueError).
    A rule fits its host and all subdomains if the url's path starts with the rule's path. The longest rule
    string wins; of a rule given both ways, block wins. No rule fits: rule is null and verdict is default.

    Null, empty and malformed urls get an empty host and path, and so no rule. Repeated rows are each
    returned. Other columns of pages, whatever their names, are not read. Empty tables give no rows; with
    no rules all rows get default. Very long urls cost no more than the rules' own depth.
    """
    rules = rules.select(lower_ascii("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_path is not null and r_verdict is not null")
    n, bad, labels, depth = rules.agg(
        F.count("*"), F.count(F.when(~F.col("r_path").rlike("(?s)^/(.*/)?$"), 1)),
        F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_path", "/")) - 1),
    ).first()
    if bad:
        raise ValueError(f"{bad} rules have a path that doesn't start and end with a slash")
    labels, depth = labels or 1, depth or 1
    rules = rules.withColumn("r_rule", F.concat("r_host", "r_path")).withColumn("r_digest", F.sha2("r_rule", 256))
    rules = rules.groupBy("r_digest", "r_rule").agg(F.max("r_verdict").alias("r_verdict")).withColumn("r_key", F.substring("r_digest", 1, 8))

    parts = F.split("u_path", "/", depth + 1)
    suffixes = F.array_distinct(F.array(*[F.substring_index("u_host", ".", -i) for i in range(1, labels + 1)]))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    # the row number only tells equal rows apart within one map task's output
    rows = pages.select(F.monotonically_increasing_id().alias("u_row"), F.struct(*[F.col(c) for c in keep]).alias("u_keep"), host_of(F.col(url_col)).alias("u_host"), path_of(F.col(url_col)).alias("u_path"))
    spread = rows.withColumn("u_prefixes", F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>")))
    spread = spread.withColumn("u_terms", F.flatten(F.transform(suffixes, lambda s: F.transform("u_prefixes", lambda p: F.concat(s, p)))))
    spread = spread.select("u_row", "u_keep", "u_host", "u_path", F.explode_outer("u_terms").alias("u_term"))
    spread = spread.withColumn("u_digest", F.sha2("u_term", 256)).withColumn("u_key", F.substring("u_digest", 1, 8))
    if n <= broadcast_rules:
        rules = F.broadcast(rules)
    met = spread.join(rules, F.col("u_key") == F.col("r_key"), "left")
    confirmed = F.when(F.col("u_digest") == F.col("r_digest"), F.struct(F.length("r_rule").alias("n"), "r_verdict", "r_rule"))
    best = met.groupBy("u_row", "u_keep", "u_host", "u_path").agg(F.max(confirmed).alias("best"))
    return best.select("u_keep.*", F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("best.r_rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filter(table(spark, sf_dir, "pages", "page_id", "url"), rules)


SQL = """
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.*, (SELECT arg_max(h || p, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule
  FROM u)
SELECT page_id, host, path, rule, coalesce((SELECT any_value(verdict) FROM r WHERE h || p = rule), 'allow') AS verdict FROM m
"""
