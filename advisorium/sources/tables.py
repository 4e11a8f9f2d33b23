"""Canonical inputs: the vulnerability observations and the reference tables, projected from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of every query; none reads the present time.
NOW = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task sorts or groups at most, where tasks are counted from the table.
ROWS_A_TASK = 500_000


def tasks_for(spark: SparkSession, sf_dir: str, name: str, rows: int = ROWS_A_TASK) -> int:
    """Tasks to deal a table over, so that a task's memory doesn't follow the table's size: the session's number, or more for a large table. Its rows are counted from the files' footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, name).count() // rows))


def vuln_raw(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Observations of vulnerabilities by sources; several rows of one cve_id are several sightings.

    seq is a sortable key of arrival, made of the row's own values: no global numbering, so no global sort.
    With tasks, the join of the two large tables is dealt over so many.
    """
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if tasks:
        line, orders = line.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    pad = lambda c, n: F.lpad(F.col(c).cast("bigint").cast("string"), n, "0")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return joined.select(
        F.concat(F.lit("CVE-"), F.year("o_orderdate").cast("string"), F.lit("-"), (F.lit(10000) + F.col("l_orderkey")).cast("string")).alias("cve_id"),
        F.col("l_suppkey").alias("source_id"), F.col("s_name").alias("source_name"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("product"), F.col("p_type").alias("domain"),
        (F.col("l_quantity") / 5).alias("cvss_score"), F.col("o_orderdate").alias("published_at"), F.col("l_shipdate").alias("collected_at"), (F.col("l_linestatus") == "O").alias("is_new"),
        F.when(F.col("o_orderstatus") == "P", "rejected").alias("cve_status"), F.when(F.col("l_returnflag") == "A", "apply update").alias("solution"),
        F.concat_ws("|", pad("l_orderkey", 12), pad("l_linenumber", 3), pad("l_partkey", 12), pad("l_suppkey", 12), F.to_date("l_shipdate").cast("string"), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 14, "0"), "l_returnflag", "l_linestatus", pad("l_quantity", 4)).alias("seq"),
    )


VULN_SQL = """
vuln_raw AS (
  SELECT concat('CVE-', year(o_orderdate)::VARCHAR, '-', (10000 + l_orderkey)::VARCHAR) AS cve_id, l_suppkey AS source_id, s_name AS source_name,
    p_brand AS vendor, p_name AS product, p_type AS domain, l_quantity / 5 AS cvss_score, o_orderdate AS published_at, l_shipdate AS collected_at,
    l_linestatus = 'O' AS is_new, CASE WHEN o_orderstatus = 'P' THEN 'rejected' END AS cve_status, CASE WHEN l_returnflag = 'A' THEN 'apply update' END AS solution,
    concat_ws('|', lpad(l_orderkey::BIGINT::VARCHAR, 12, '0'), lpad(l_linenumber::BIGINT::VARCHAR, 3, '0'), lpad(l_partkey::BIGINT::VARCHAR, 12, '0'), lpad(l_suppkey::BIGINT::VARCHAR, 12, '0'),
      l_shipdate::DATE::VARCHAR, lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 14, '0'), l_returnflag, l_linestatus, lpad(l_quantity::BIGINT::VARCHAR, 4, '0')) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def sql(body: str) -> str:
    """An oracle over vuln_raw: the body may start with more common table expressions, each ended by a comma."""
    return f"WITH {VULN_SQL}\n{body}"
