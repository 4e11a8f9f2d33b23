"""Whether texts that were written from others hold only, or hold all, of their technical values: met as tokens, not text by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that must not change: ids, weaknesses, urls, score vectors, CPEs and versions (fixed patterns).
TECHNICAL = [r"(?i)CVE-\d{4}-\d{4,}", r"(?i)CWE-\d+", r"(?i)https?://[^\s<>\"')]+", r"CVSS:\d\.\d/[A-Z:/.\d]+", r"(?i)cpe:2\.3:[^\s]+", r"\b\d+\.\d+(?:\.\d+){0,3}\b"]


def technical_values(text: Column) -> Column:
    """The distinct technical values of a text, sorted; none for null."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in TECHNICAL])
    return F.array_sort(F.array_distinct(found))


def missing_values(expected: Column, text: Column) -> Column:
    """Technical values of one text that don't stand in another, in either case, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(technical_values(expected), lambda x: ~F.contains(low, F.lower(x)))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows as the right side of a join that deals both sides over tasks: pages shrink so much when written that they would be broadcast, at many times the size."""
    return rows.hint("merge")


def ungrounded(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """texts (id, field, said) with id, field, invented: the technical values that stand in none of an id's pages (id, page).

    A value meets the values of its own pages by equality first; only what is left is looked for within the pages' texts, as a value may be part of a
    longer one. Texts without technical values, and those whose values are all found, give an empty list.
    """
    said = texts.select("id", "field", F.explode(technical_values(F.col("said"))).alias("value")).withColumn("low", F.lower("value"))
    own = pages.select(F.col("id").alias("p_id"), F.explode(technical_values(F.col("page"))).alias("p_value")).select("p_id", F.lower("p_value").alias("p_value")).distinct()
    left = said.join(_dealt(own), (F.col("id") == F.col("p_id")) & (F.col("low") == F.col("p_value")), "left_anti")
    read = pages.select(F.col("id").alias("p_id"), F.lower("page").alias("p_text"))
    held = left.join(_dealt(read), (F.col("id") == F.col("p_id")) & F.contains("p_text", F.col("low")), "left_anti")
    lost = held.groupBy(F.col("id").alias("l_id"), F.col("field").alias("l_field")).agg(F.array_sort(F.collect_set("value")).alias("invented"))
    return texts.join(_dealt(lost), F.col("id").eqNullSafe(F.col("l_id")) & (F.col("field") == F.col("l_field")), "left").select("id", "field", F.coalesce("invented", F.array().cast("array<string>")).alias("invented"))


def grounded(drafts: DataFrame, pages: DataFrame) -> DataFrame:
    """drafts (id, summary, solution, url) with what their pages (id, url, name, page) bear out: id, summary, solution, solution_url, solution_name, status.

    A summary or a solution with a value that no page of its id holds is dropped, and so is a solution whose url is none of the
    pages read. status is insufficient without pages or if nothing is left, failed for a draft that says nothing at all though pages were
    read, else completed.
    """
    bare = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = drafts.select("id", bare("summary").alias("summary"), bare("solution").alias("solution"), bare("url").alias("url"))
    texts = rows.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("said")) for f in ("summary", "solution")])).alias("t")).select("id", "t.*").where("said is not null")
    bad = ungrounded(texts, pages).where(F.size("invented") > 0).groupBy(F.col("id").alias("b_id")).agg(F.collect_set("field").alias("bad"))
    read = pages.groupBy(F.col("id").alias("r_id")).agg(F.count("*").alias("pages"))
    sources = pages.groupBy(F.col("id").alias("s_id"), F.col("url").alias("s_url")).agg(F.min("name").alias("s_name"))
    both = rows.join(_dealt(bad), F.col("id") == F.col("b_id"), "left").join(_dealt(read), F.col("id") == F.col("r_id"), "left").join(_dealt(sources), (F.col("id") == F.col("s_id")) & (F.col("url") == F.col("s_url")), "left")
    fine = lambda f: ~F.coalesce(F.array_contains("bad", f), F.lit(False)) & F.col("pages").isNotNull()
    summary, solution = F.when(fine("summary"), F.col("summary")), F.when(fine("solution") & F.col("s_url").isNotNull(), F.col("solution"))
    silent = F.col("summary").isNull() & F.col("solution").isNull() & F.col("pages").isNotNull() & F.col("url").isNull()
    status = F.when(summary.isNotNull() | solution.isNotNull(), "completed").when(silent, "failed").otherwise("insufficient")
    return both.select("id", summary.alias("summary"), solution.alias("solution"), F.when(solution.isNotNull(), F.col("s_url")).alias("solution_url"), F.when(solution.isNotNull(), F.col("s_name")).alias("solution_name"), status.alias("status"))


def accepted_translations(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows (id, and by field its text and <field>_fr as translated) with id, <field>_fr, status, kept and warning.

    A translation is accepted field by field if it keeps all technical values of its source. status is not_required if no source has a
    text, completed if any field was accepted, else failed; kept names the accepted fields, warning those that lost values, with up to three.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = []
    for f in sorted(fields):
        lost = missing_values(F.col(f), F.col(f"{f}_fr"))
        given = said(F.col(f)).isNotNull() & said(F.col(f"{f}_fr")).isNotNull()
        parts.append(F.struct(F.lit(f).alias("field"), (given & (F.size(lost) == 0)).alias("ok"), F.when(given, lost).otherwise(F.array().cast("array<string>")).alias("lost")))
    told = rows.withColumn("t_parts", F.array(*parts))
    kept = F.transform(F.filter("t_parts", lambda p: p["ok"]), lambda p: p["field"])
    lost = F.filter("t_parts", lambda p: F.size(p["lost"]) > 0)
    warning = F.nullif(F.array_join(F.transform(lost, lambda p: F.concat(p["field"], F.lit(" ("), F.array_join(F.slice(p["lost"], 1, 3), ", "), F.lit(")"))), "; "), F.lit(""))
    needed = F.coalesce(*[said(F.col(f)) for f in fields]).isNotNull()
    status = F.when(~needed, "not_required").when(F.size(kept) > 0, "completed").otherwise("failed")
    own = lambda f: F.when(F.array_contains(kept, f), F.trim(f"{f}_fr")).alias(f"{f}_fr")
    return told.select("id", *[own(f) for f in fields], status.alias("status"), kept.alias("kept"), warning.alias("warning"))
