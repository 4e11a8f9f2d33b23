"""The catalogue of monitored products, compiled, and records met with it by CPE, by aliases and by free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.functions import matching
from advisorium.operators.matching import GRADES
from advisorium.operators.records import small


def _said(items: Column) -> Column:
    """The items that are neither null nor empty, lower case, each once, in order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.transform(F.filter(F.coalesce(items, none), lambda x: x != ""), F.lower))


def compiled(products: DataFrame, domains: DataFrame) -> DataFrame:
    """Active products: name, vendor, domain, position, broad, strict, specific, vendor_only, cpes.

    products has name, vendor, domain, aliases, keywords, cpes (arrays), enabled and position; domains has name and enabled. A
    product is active unless it, or its domain, is disabled, and if it has a name; null counts as enabled. broad is its name, vendor and
    name, aliases and keywords; strict its keywords, else its aliases, else its name; vendor_only the broad ones that are no more than
    its vendor, unless it is called like its vendor; specific the others.
    """
    off = domains.where("enabled = false").select(F.col("name").alias("off_name")).distinct()
    name, vendor = F.coalesce("name", F.lit("")), F.coalesce("vendor", F.lit(""))
    rows = products.where((name != "") & ~F.coalesce(F.col("enabled") == F.lit(False), F.lit(False))).join(small(off), F.col("domain") == F.col("off_name"), "left_anti")
    full = F.when(vendor != "", F.concat(vendor, F.lit(" "), name))
    broad = _said(F.concat(F.array(name, full), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("keywords", F.array().cast("array<string>"))))
    given = lambda c: F.size(_said(F.col(c))) > 0
    strict = F.when(given("keywords"), _said(F.col("keywords"))).when(given("aliases"), _said(F.col("aliases"))).otherwise(_said(F.array(name)))
    brand = F.lower(F.trim(vendor))
    alone = lambda a: (brand != "") & (F.lower(F.trim(name)) != brand) & (F.trim(a) == brand)
    made = rows.select(name.alias("name"), vendor.alias("vendor"), F.coalesce("domain", F.lit("")).alias("domain"), "position", broad.alias("broad"), strict.alias("strict"), _said(F.col("cpes")).alias("cpes"), brand.alias("brand"))
    brand, name = F.col("brand"), F.col("name")
    return made.withColumn("specific", F.filter("broad", lambda a: ~alone(a))).withColumn("vendor_only", F.filter("broad", alone)).drop("brand")


def cpe_list(one: list[Column], many: list[Column]) -> Column:
    """CPEs of a record, lower case, out of texts and of arrays, in that order; nulls left out."""
    none = F.array().cast("array<string>")
    texts = F.transform(F.filter(F.array(*one), lambda x: x.isNotNull()), F.lower) if one else none
    return reduce(F.concat, [F.transform(F.filter(F.coalesce(c, none), lambda x: x != ""), F.lower) for c in many], texts)


def _runs(cpe: Column) -> Column:
    """All runs of whole parts within a CPE, colons on both sides: those that start after its first colon and end before its last."""
    parts = F.split(cpe, ":")
    n = F.size(parts)
    starts = F.when(n >= 3, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i), lambda m: F.concat(F.lit(":"), F.array_join(F.slice(parts, i, m), ":"), F.lit(":"))))))


def _open(cpe: Column) -> Column:
    """All stretches of one to three characters of a text."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(cpe)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda m: F.substring(cpe, i, m)))))


def cpe_join(cpes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cpe, want) of distinct texts in cpes (cpe) and wanted (want) where want starts or stands anywhere within cpe.

    A wanted CPE of three parts or more is cut by its colons: the parts between its first and its last colon stand whole in any text
    that holds it, so both meet by equality on that run. Shorter ones meet by their first three characters.
    """
    own = cpes.select("cpe").where("cpe <> ''").distinct()
    want = wanted.select("want").where("want <> ''").distinct()
    parts = F.split("want", ":")
    long = want.where(F.size(parts) >= 3).withColumn("c_key", F.concat(F.lit(":"), F.array_join(F.slice(parts, 2, F.size(parts) - 2), ":"), F.lit(":")))
    short = want.where(F.size(parts) < 3).withColumn("c_key", F.left("want", F.lit(3)))
    by_run = own.select("cpe", F.explode(_runs(F.col("cpe"))).alias("c_key")).join(small(long), "c_key")
    by_gram = own.select("cpe", F.explode(_open(F.col("cpe"))).alias("c_key")).join(small(short), "c_key")
    return by_run.unionByName(by_gram).where(F.contains("cpe", F.col("want"))).select("cpe", "want").distinct()


def word_join(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(text, alias) of distinct texts and aliases that stand in them between other characters than a-z and 0-9.

    Both are lower case. A text's words meet the aliases' longest words by equality, then the whole alias is looked for. Aliases
    without a word meet nothing.
    """
    words = lambda c: F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")
    known = aliases.select("alias").distinct().withColumn("w_all", words("alias")).where(F.size("w_all") > 0)
    longest = F.aggregate("w_all", F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    exact = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(F.col("alias"), F.lit("\\E"), F.lit("")), F.lit(r"\E(?![a-z0-9])"))
    known = known.select("alias", longest.alias("w_key"), exact.alias("w_exact"))
    own = texts.select("text").where("text <> ''").distinct()
    met = own.withColumn("w_key", F.explode(F.array_distinct(words("text")))).join(small(known), "w_key")
    return met.where(F.contains("text", F.col("alias"))).where(F.rlike("text", F.col("w_exact"))).select("text", "alias")


def title_vendors(titles: DataFrame, vendors: DataFrame, title: str = "title") -> DataFrame:
    """titles with vendor: the longest of the vendors (vendor) that a title names, as it is shown, else the capitalised word after product.

    Of vendors of one length the first in order counts. Distinct titles meet the vendors by words, whatever their number.
    """
    own = titles.select(F.lower(title).alias("text")).distinct()
    met = word_join(own, vendors.select(F.lower("vendor").alias("alias")))
    best = met.groupBy("text").agg(F.min_by("alias", F.struct(-F.length("alias"), "alias")).alias("v_best"))
    both = titles.withColumn("v_text", F.lower(title)).join(best, F.col("v_text") == F.col("text"), "left")
    return both.withColumn("vendor", F.coalesce(matching.title_name(F.col("v_best")), matching.named_product(F.col(title)))).drop("v_text", "v_best", "text")


def _evidence(records: DataFrame, products: DataFrame, kinds: dict[str, tuple[str, int]]) -> DataFrame:
    """(r_cpes, r_structured, r_free, name, rank) by the first match of each kind; kinds: alias column -> (text column, rank)."""
    empty = F.coalesce(F.trim("r_structured"), F.lit("")) == ""
    found = []
    for aliases, (column, rank) in kinds.items():
        rows = records.where(~empty if column == "r_structured" else empty).withColumn("text", F.lower(F.col(column)))
        own = products.select("name", F.explode(aliases).alias("alias")).distinct()
        met = word_join(rows, own).join(small(own), "alias").select("text", "name").distinct()
        found.append(rows.join(met, "text").select("r_cpes", "r_structured", "r_free", "name", F.lit(rank).alias("rank")))
    return reduce(DataFrame.unionByName, found)


def _by_cpe(records: DataFrame, products: DataFrame) -> DataFrame:
    """(r_cpes, r_structured, r_free, name, cpe): the first CPE of a record that each product speaks of."""
    wanted = products.select("name", F.explode("cpes").alias("want")).distinct()
    each = records.select("r_cpes", "r_structured", "r_free", F.posexplode("r_cpes").alias("at", "cpe"))
    met = cpe_join(each, wanted).join(small(wanted), "want").select("cpe", "name").distinct()
    return each.join(met, "cpe").groupBy("r_cpes", "r_structured", "r_free", "name").agg(F.min(F.struct("at", "cpe")).alias("f")).select("r_cpes", "r_structured", "r_free", "name", "f.cpe")


def _distinct(records: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return records.select(F.coalesce("cpes", none).alias("r_cpes"), F.coalesce("structured", F.lit("")).alias("r_structured"), F.coalesce("free", F.lit("")).alias("r_free")).distinct()


def _with(records: DataFrame, found: DataFrame) -> DataFrame:
    """records joined back with what their distinct evidence gave."""
    none = F.array().cast("array<string>")
    keyed = records.withColumn("r_cpes", F.coalesce("cpes", none)).withColumn("r_structured", F.coalesce("structured", F.lit(""))).withColumn("r_free", F.coalesce("free", F.lit("")))
    return keyed.join(found, ["r_cpes", "r_structured", "r_free"]).drop("r_cpes", "r_structured", "r_free")


def graded(records: DataFrame, products: DataFrame) -> DataFrame:
    """records (cpes, structured, free, more) with each product that they speak of: product, domain, grade, evidence.

    products is that of compiled(). confirmed: one of its CPEs stands in one of the record's. high_confidence: a specific alias
    stands in the structured text. rejected: only its vendor does. possible: nothing is structured and a strict alias stands
    in the free text. A product of several rows of one name gets its surest grade, with the domain of its first position. Equal
    evidence is matched once and joined back.
    """
    rows = _distinct(records)
    sure = _by_cpe(rows, products).select("r_cpes", "r_structured", "r_free", "name", F.lit(0).alias("rank"), F.concat(F.lit("CPE "), F.left("cpe", F.lit(60))).alias("evidence"))
    read = _evidence(rows, products, {"specific": ("r_structured", 1), "vendor_only": ("r_structured", 3), "strict": ("r_free", 2)})
    told = F.when(F.col("rank") == 1, "product alias in structured fields").when(F.col("rank") == 2, "product alias in free text").otherwise("vendor alone")
    best = sure.unionByName(read.withColumn("evidence", told)).groupBy("r_cpes", "r_structured", "r_free", "name").agg(F.min(F.struct("rank", "evidence")).alias("b"))
    named = products.groupBy("name").agg(F.min_by("domain", "position").alias("domain"))
    grade = F.element_at(F.array(*[F.lit(x) for x in GRADES]), F.col("b.rank") + 1)
    found = best.join(small(named), "name").select("r_cpes", "r_structured", "r_free", F.col("name").alias("product"), "domain", grade.alias("grade"), F.col("b.evidence").alias("evidence"))
    return _with(records, found)


def matched(records: DataFrame, products: DataFrame) -> DataFrame:
    """records (cpes, structured, free, more) with each product and domain they match by the older, ungraded rule, and whether it is the primary one.

    CPE matches, and broad aliases in the structured text; without either text, strict aliases in the free text, unless a CPE
    matched. Primary is the first: CPE matches first, then by position.
    """
    rows = _distinct(records)
    sure = _by_cpe(rows, products).select("r_cpes", "r_structured", "r_free", "name", F.lit(0).alias("rank"))
    read = _evidence(rows, products, {"broad": ("r_structured", 1), "strict": ("r_free", 2)})
    known = sure.select("r_cpes", "r_structured", "r_free").distinct()
    free = read.where("rank = 2").join(known, ["r_cpes", "r_structured", "r_free"], "left_anti")
    hits = sure.unionByName(read.where("rank = 1")).unionByName(free).groupBy("r_cpes", "r_structured", "r_free", "name").agg(F.min("rank").alias("rank"))
    placed = hits.join(small(products.select("name", "domain", "position")), "name")
    pairs = placed.groupBy("r_cpes", "r_structured", "r_free", "name", "domain").agg(F.min(F.struct("rank", "position")).alias("place"))
    first = pairs.groupBy("r_cpes", "r_structured", "r_free").agg(F.min(F.struct("place", "name", "domain")).alias("first"))
    both = pairs.join(first, ["r_cpes", "r_structured", "r_free"])
    primary = (F.col("first.name") == F.col("name")) & (F.col("first.domain") == F.col("domain"))
    return _with(records, both.select("r_cpes", "r_structured", "r_free", F.col("name").alias("product"), "domain", primary.alias("is_primary")))
