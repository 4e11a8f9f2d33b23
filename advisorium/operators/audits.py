"""Audits of a whole collection of records, with their repairs: faults by rule, and values copied from advisories of many vendors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.functions import text, urls
from advisorium.functions.matching import structured_text
from advisorium.operators import catalogue
from advisorium.operators.records import small

#: Words of companies' names and of techniques, which name no brand (fixed values).
NO_BRANDS = [
    "software", "systems", "technologies", "technology", "group", "corporation", "corp", "inc", "ltd", "labs", "security", "solutions", "international", "company", "project", "foundation", "team", "open", "source", "server",
    "cloud", "data", "digital", "global", "enterprise", "consulting", "trade", "code", "service", "system", "network", "platform", "application", "applications", "desktop", "studio", "manager", "engine", "framework", "library", "module",
    "services", "produits", "produit", "version", "versions", "update", "updates",
]
#: Parts of entries that are no vendor (fixed values).
BAD_VENDORS = ["élévation", "elevation", "privilèg", "privileg", "déni", "denial", "exécution", "execution", "contournement", "bypass", "injection", "dépassement", "overflow", "divulgation", "disclosure", "cross-site", "traversal", "spoofing", "vulnérab"]
#: Fields that advisories of many vendors are copied into (fixed values).
COPIED = ["affected_systems", "impact", "solution"]
TAG, ENTITY = r"<[a-zA-Z/!][^>]{0,80}>", r"&(nbsp|apos|#39);"
REVOKED = r"(?i)do not use this cve (record|id)|rejected reason"


def foreign_source(url: Column, cve_id: Column) -> Column:
    """Whether a url names CVE ids and the record's own isn't among them."""
    named = text.cve_ids(url)
    return F.coalesce((F.size(named) > 0) & ~F.array_contains(named, F.upper(cve_id)), F.lit(False))


def fault_rules() -> dict[str, Column]:
    """The audit's rules, by letter and name, as conditions on a record."""
    marked = lambda c: F.coalesce(F.col(c).rlike(TAG) | F.col(c).rlike(ENTITY), F.lit(False))
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return {
        "A_frame_references": F.coalesce(F.exists("references", urls.decorative), F.lit(False)),
        "B_advisory_date_as_publication": F.coalesce(F.col("published_at") == F.col("advisory_published_at"), F.lit(False)),
        "C_unusable_description": said("description") & text.clean_description(F.col("description")).isNull(),
        "D_unusable_solution": said("solution") & text.clean_text(F.col("solution")).isNull(),
        "E_foreign_official_source": foreign_source(F.col("official_source_url"), F.col("cve_id")),
        "F_marked_up_text": marked("description") | marked("solution"),
        "G_revoked_record": F.coalesce(F.col("description").rlike(REVOKED), F.lit(False)),
    }


def with_faults(records: DataFrame) -> DataFrame:
    """records with the array of the rules that they break, in order of the rules. Nulls break none."""
    rules = fault_rules()
    return records.withColumn("faults", F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull()))


def fault_counts(records: DataFrame) -> DataFrame:
    """By rule: how many records break it, all rules listed, and how many records there are."""
    rules = list(fault_rules())
    one = with_faults(records).agg(F.count("*").alias("records"), *[F.count_if(F.array_contains("faults", r)).alias(r) for r in rules])
    return one.select("records", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])).alias("x")).select("x.rule", "x.n", "records")


def repaired(records: DataFrame) -> DataFrame:
    """records with every fault mended in one pass, and the array of the faults that they had.

    Nothing is made up: what can't be used is emptied, references of a frame are left out, mark-up is taken off texts that stay,
    revoked records are marked.
    """
    broken = lambda rule: F.array_contains("faults", rule)
    rules = {r[0]: r for r in fault_rules()}
    marked = lambda c: F.when(F.col(c).rlike(TAG) | F.col(c).rlike(ENTITY), F.coalesce(text.bare_text(F.col(c)), F.col(c))).otherwise(F.col(c))
    out = with_faults(records)
    mended = {
        "references": F.when(broken(rules["A"]), F.filter("references", lambda r: ~urls.decorative(r))).otherwise(F.col("references")),
        "published_at": F.when(~broken(rules["B"]), F.col("published_at")),
        "validation_status": F.when(broken(rules["B"]), "insufficient_data").otherwise(F.col("validation_status")),
        "description": F.when(~broken(rules["C"]), marked("description")),
        "solution": F.when(~broken(rules["D"]), marked("solution")),
        "official_source_url": F.when(~broken(rules["E"]), F.col("official_source_url")),
        "cve_status": F.when(broken(rules["G"]), "rejected").otherwise(F.col("cve_status")),
    }
    return out.withColumns(mended)


def _tokens(value: Column, least: int) -> Column:
    """Distinct words of a text, lower case, cut at anything but digits and Latin letters."""
    words = F.split(F.lower(F.coalesce(value, F.lit(""))), "[^0-9a-zÀ-ɏ]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(NO_BRANDS)))


def valid_vendor(vendor: Column) -> Column:
    """Whether an entry can be a vendor: 2 to 90 characters, and none of the words that name a fault."""
    low = F.lower(F.trim(vendor))
    bad = F.lit(False)
    for x in BAD_VENDORS:
        bad |= low.contains(x)
    return F.coalesce((F.length(low) >= 2) & (F.length(vendor) <= 90) & ~bad, F.lit(False))


def contaminated(records: DataFrame, least: int = 3) -> DataFrame:
    """(cve_id, field, value, protected): values of a record that name another vendor and not its own, and that so many such records share.

    records has cve_id, vendor, cve_status, verified (names of fields with verified provenance), affected_systems (array), impact and solution.
    Brands are words of four letters or more of the valid vendors at hand. Records that are rejected, or whose vendor has no word, are never
    judged. A distinct value's words meet the brands once, and are joined back by the value.
    """
    rows = records.where(~F.col("cve_status").eqNullSafe("rejected"))
    brands = rows.where(valid_vendor(F.col("vendor"))).select("vendor").distinct().select(F.explode(_tokens(F.col("vendor"), 4)).alias("brand")).distinct()
    told = {"affected_systems": F.array_join("affected_systems", "\u0000"), "impact": F.trim("impact"), "solution": F.trim("solution")}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in told.items()])
    each = rows.select("cve_id", _tokens(F.col("vendor"), 2).alias("own"), F.coalesce("verified", F.array().cast("array<string>")).alias("verified"), F.explode(fields).alias("f"))
    each = each.select("cve_id", "own", "verified", "f.field", "f.value").where((F.col("value") != "") & (F.size("own") > 0))
    cited = each.select("value").distinct().select("value", F.explode(_tokens(F.replace("value", F.lit("\u0000"), F.lit(" ")), 1)).alias("brand")).join(small(brands), "brand")
    cited = cited.groupBy(F.col("value").alias("c_value")).agg(F.collect_set("brand").alias("cited"))
    strange = each.join(cited, F.col("value") == F.col("c_value")).where(~F.arrays_overlap("cited", "own"))
    shared = strange.groupBy(F.col("field").alias("s_field"), F.col("value").alias("s_value")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    met = strange.join(shared, (F.col("field") == F.col("s_field")) & (F.col("value") == F.col("s_value")))
    return met.select("cve_id", "field", "value", F.array_contains("verified", F.col("field")).alias("protected"))


def isolated(records: DataFrame, products: DataFrame, least: int = 3) -> DataFrame:
    """records without contaminated values that aren't protected, and with their scope told anew: emptied (fields), monitored_products,
    domains, monitored_product, domain, match_confidence, match_evidence and rescoped (whether the products changed).

    products is that of catalogue.compiled(). Scope is told from the records as they were given; rejected ones keep theirs. cve_id must be unique.
    """
    empty = F.array().cast("array<string>")
    bad = contaminated(records, least).where("not protected").groupBy(F.col("cve_id").alias("b_id")).agg(F.array_sort(F.collect_set("field")).alias("emptied"))
    seen = records.where(~F.col("cve_status").eqNullSafe("rejected"))
    free = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    evidence = seen.select("cve_id", F.coalesce("cpes", empty).alias("cpes"), structured_text(F.col("vendor"), F.col("product"), F.col("affected_products"), F.col("affected_systems")).alias("structured"), F.lower(F.trim(free)).alias("free"))
    order = products.groupBy(F.col("name").alias("o_name")).agg(F.min("position").alias("position"))
    kept = catalogue.graded(evidence, products).where("grade <> 'rejected'").join(small(order), F.col("product") == F.col("o_name"))
    rank = F.array_position(F.array(*[F.lit(g) for g in catalogue.GRADES]), F.col("grade"))
    scope = kept.groupBy(F.col("cve_id").alias("s_id")).agg(F.array_sort(F.collect_set("product")).alias("s_products"), F.array_sort(F.collect_set(F.nullif("domain", F.lit("")))).alias("s_domains"), F.min_by(F.struct("product", "domain", "grade", "evidence"), F.struct(rank, "position")).alias("first"))
    both = records.join(bad, F.col("cve_id") == F.col("b_id"), "left").join(scope, F.col("cve_id") == F.col("s_id"), "left")
    judged = ~F.col("cve_status").eqNullSafe("rejected")
    products_now = F.when(judged, F.coalesce("s_products", empty)).otherwise(F.col("monitored_products"))
    changed = judged & (F.array_sort(F.coalesce("monitored_products", empty)) != products_now)
    cleared = {f: F.when(~F.array_contains(F.coalesce("emptied", empty), f), F.col(f)).alias(f) for f in COPIED}
    new = {
        "monitored_products": F.when(changed, products_now).otherwise(F.col("monitored_products")), "domains": F.when(changed, F.coalesce("s_domains", empty)).otherwise(F.col("domains")),
        "monitored_product": F.when(changed, F.col("first.product")).otherwise(F.col("monitored_product")), "domain": F.when(changed, F.col("first.domain")).otherwise(F.col("domain")),
        "match_confidence": F.when(changed, F.coalesce("first.grade", F.lit("rejected"))).otherwise(F.col("match_confidence")),
        "match_evidence": F.when(changed, F.coalesce("first.evidence", F.lit("no monitored product"))).otherwise(F.col("match_evidence")),
    }
    columns = [cleared.get(c, new[c].alias(c) if c in new else F.col(c)) for c in records.columns]
    return both.select(*columns, F.coalesce("emptied", empty).alias("emptied"), changed.alias("rescoped"))
