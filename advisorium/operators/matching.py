"""Records met with monitored products, with and without grades of confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advisorium.functions import matching
from advisorium.operators.records import alias_match, small

#: Grades of a match, surest first (fixed values).
GRADES = ["confirmed", "high_confidence", "possible", "rejected"]


def graded_match(evidence: DataFrame, products: DataFrame) -> DataFrame:
    """evidence (cpe, structured, free, more) with each product (name, vendor, cpe) that it speaks of, and the surest grade.

    confirmed: the product's CPE is the first five parts of the record's. high_confidence: its name stands in the structured
    text. rejected: only its vendor does. possible: nothing is structured and the name stands in the free text. Every step is
    an equi-join, on CPE or on first words of names; give distinct evidence, as equal rows come out once. Null texts match nothing.
    """
    told = evidence.columns
    empty = F.coalesce(F.col("structured"), F.lit("")) == ""
    plain = products.select("name", "vendor").distinct()
    by_cpe = evidence.withColumn("m_cpe", F.substring_index("cpe", ":", 5)).join(small(products.select("name", F.col("cpe").alias("m_cpe")).where("m_cpe is not null").distinct()), "m_cpe")
    by_name = alias_match(evidence.where(~empty), plain.select("name"), "structured")
    by_text = alias_match(evidence.where(empty), plain.select("name"), "free")
    vendors = plain.select(F.col("vendor").alias("m_vendor"), F.col("name").alias("m_name"))
    by_vendor = alias_match(evidence.where(~empty), plain.select(F.col("vendor").alias("name")), "structured").withColumnRenamed("name", "m_vendor").join(small(vendors), "m_vendor").withColumnRenamed("m_name", "name")
    parts = [part.select(*told, "name", F.lit(k).alias("m_rank")) for k, part in enumerate([by_cpe, by_name, by_text, by_vendor])]
    met = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    best = met.groupBy(*told, "name").agg(F.min("m_rank").alias("m_rank"))
    return best.select(*told, "name", F.element_at(F.array(*[F.lit(x) for x in GRADES]), F.col("m_rank") + 1).alias("grade"))


def ungraded_match(evidence: DataFrame, products: DataFrame) -> DataFrame:
    """evidence (structured, free, more) with each product (name, vendor) whose broad aliases, its vendor among them, stand in the
    structured text, or, where that is empty, whose strict aliases stand in the free text. Equal rows come out once."""
    told = evidence.columns
    empty = F.coalesce(F.col("structured"), F.lit("")) == ""
    own = products.select(F.col("name").alias("m_name"), matching.auto_aliases(F.col("name"), F.col("vendor")).alias("m_all"))

    def met(rows: DataFrame, kind: str, column: str) -> DataFrame:
        aliases = own.select("m_name", F.explode(f"m_all.{kind}").alias("name")).distinct()
        return alias_match(rows, aliases.select("name"), column).join(small(aliases), "name").select(*told, F.col("m_name").alias("name"))

    return met(evidence.where(~empty), "broad", "structured").unionByName(met(evidence.where(empty), "strict", "free")).distinct()
