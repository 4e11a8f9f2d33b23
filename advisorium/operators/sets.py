"""Set algebra of lists in rows and of tables: scopes, vocabularies, unions and upserts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag_union(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts by column name; columns that a part lacks are null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def ordered_union(a: Column, b: Column) -> Column:
    """Distinct elements of a and then b, in order of first sight; a null list counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same elements, whatever their order and number."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def vocabulary(names: DataFrame, column: str, stop: list[str], least: int = 4) -> DataFrame:
    """Distinct words of at least so many characters of a column, in lower case, without stop words: word."""
    words = names.select(F.explode(F.split(F.lower(column), "[^a-z0-9]+")).alias("word"))
    return words.where((F.length("word") >= least) & ~F.col("word").isin(stop)).distinct()


def appended_once(stored: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """stored, and those rows of more whose key is in neither stored nor, in order, twice in more; keys are compared in lower case, nulls left out of more."""
    low = F.lower(F.trim(key))
    fresh = more.where(F.col(key).isNotNull()).groupBy(low.alias("a_key")).agg(F.min(F.struct(*more.columns)).alias("a_row"))
    known = stored.select(low.alias("a_key")).distinct()
    return stored.unionByName(fresh.join(known, "a_key", "left_anti").select("a_row.*"))


def scope_merge(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored and new records by key: scopes and sources as unions, the earlier first_published, confirmed if either is.

    Both have scopes and sources (arrays of strings), first_published and confirmed. A key on one side only stays as it is.
    """
    old = stored.select(F.col(key).alias("o_key"), *[F.col(c).alias(f"o_{c}") for c in ("scopes", "sources", "first_published", "confirmed")])
    both = new.join(old, F.col(key) == F.col("o_key"), "full_outer")
    none = F.lit(False)
    return both.select(
        F.coalesce(key, "o_key").alias(key), F.array_sort(ordered_union(F.col("o_scopes"), F.col("scopes"))).alias("scopes"), F.array_sort(ordered_union(F.col("o_sources"), F.col("sources"))).alias("sources"),
        F.least("first_published", "o_first_published").alias("first_published"), (F.coalesce("confirmed", none) | F.coalesce("o_confirmed", none)).alias("confirmed"),
    )


def list_filtered(products: DataFrame, domain: str | None = None, vendor: str | None = None, enabled: bool | None = None, words: str | None = None) -> DataFrame:
    """Products by domain, vendor (in either case), state, and a pattern in name, vendor or any alias; conditions that are None don't count."""
    found = F.lit(True)
    if domain is not None:
        found &= F.col("domain") == domain
    if vendor is not None:
        found &= F.lower("vendor") == vendor.lower()
    if enabled is not None:
        found &= F.coalesce("enabled", F.lit(True)) == enabled
    if words is not None:
        pattern = f"(?i){words}"
        found &= F.col("name").rlike(pattern) | F.col("vendor").rlike(pattern) | F.exists("aliases", lambda a: a.rlike(pattern))
    return products.where(found)
