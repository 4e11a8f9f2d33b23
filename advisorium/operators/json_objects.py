"""Records out of JSON of any shape, by patterns over its text; comments, from its nodes as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advisorium.functions import text as text_functions
from advisorium.operators import json_text
from advisorium.operators.json_nodes import json_nodes

#: Keys by which a record's fields go, in lower case (fixed values).
ALIASES = {
    "title": ["title", "cvetitle", "vulnerabilityname", "headline", "name"], "description": ["description", "summary", "shortdescription", "unformatteddescription"],
    "severity": ["baseseverity", "severity"], "score": ["basescore", "cvssscore", "score"], "product": ["product", "packagename", "affectedproduct"],
    "vendor": ["vendor", "vendorproject", "issuingcna"], "versions": ["vulnerable_version_range", "affectedversions", "versionaffected"],
    "solution": ["solution", "remediation", "requiredaction", "recommendation", "mitigation", "fix", "fixinformation"],
}
_ID = r"[Cc][Vv][Ee]-\d{4}-\d{4,}"
#: A text up to its first id, which is a group; letters and digits of escapes are none of an id's. And one that is no name.
_TO_ID = rf'"(?:[^"\\Cc]++|(?!{_ID})[Cc]|\\u.{{4}}|\\[^u])*+({_ID})'
WITH_ID = rf'{_TO_ID}{json_text.CHARS}"(?!:)'
#: Keys under which a weakness stands (fixed values).
WEAKNESS_KEYS = ["cwe", "cweid", "cwe_id"]
SCHEMA = "cve_id string, title string, description string, severity string, score string, product string, vendor string, versions string, solution string, refs array<string>, weaknesses array<string>, weakness string"


def json_records(bodies: DataFrame, most: int = 12) -> DataFrame:
    """bodies (doc, body) as a record for each of their objects with an id: doc, at and the columns of SCHEMA.

    Of a text the objects with an id of the list that has most of them count, the first of several lists; else the whole object. Within a
    list objects keep their order; members of an object are met in the order of their names.
    A field is the first text or number under one of its names, an object's own before those within it; a description in English before
    any other; product and vendor by the first CPE where no field names a product; urls in the order of the text. Texts that are null, no
    JSON, or nested too deeply, and those without an id, give no row. A text is read in its row, by patterns: no node of it becomes a row.
    """
    once_a_row = lambda c, name: F.explode(F.array(c)).alias(name)
    holds = lambda x: x.rlike(WITH_ID)
    record = lambda x: F.when(x.startswith("{") & holds(x), x)
    rows = bodies.select("doc", once_a_row(json_text.canonical(F.col("body")), "body")).where(F.col("body").rlike(_ID))
    # the members of each list with ids, null where they are no records, and the list that has most records
    lists = F.filter(F.regexp_extract_all("body", F.lit(json_text.LISTS), F.lit(1)), holds)
    members = F.transform(lists, lambda x: F.transform(F.regexp_extract_all(x, F.lit(json_text.MEMBERS), F.lit(1)), record))
    counted = F.transform(members, lambda m, i: F.struct(F.size(F.array_compact(m)).alias("n"), (-i).alias("i"), m.alias("members")))
    rows = rows.select("doc", "body", once_a_row(F.array_max(counted), "best"))
    rows = rows.select("doc", F.posexplode(F.when(F.col("best.n") > 0, F.col("best.members")).otherwise(F.array(record(F.col("body"))))).alias("at", "json")).where("json is not null")
    rows = rows.select("doc", "at", "json", once_a_row(json_text.own_first(F.col("json")), "t"))

    text = lambda pattern, t="t": F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    names = lambda keys: f"(?i:{'|'.join(keys)})".replace("k", "[kK]")
    named = lambda keys: text(rf'":{names(keys)}":"?((?<=:"){json_text.CHARS}|(?<=:)-?\d[^,}}]*+)', "fields")
    fields = rf'":(?=[A-Za-z]){names([*sum(ALIASES.values(), []), *WEAKNESS_KEYS])}":(?:"(?!"){json_text.CHARS}"|-?\d[^,}}]*+)'
    unsaid = r"(?:Other|(?i:noinfo))"
    weaknesses = F.when(F.col("json").contains("CWE-"), F.array_distinct(F.regexp_extract_all("json", F.lit(r"CWE-\d+"), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    # each node's first CPE with a product, as far as that
    part = r'(?:[^":\\]|\\.)*+'
    cpes = F.regexp_extract_all("t", F.lit(rf'":"(cpe:2\.3:{part}:{part}:(?![*-]?[":]){part}){json_text.CHARS}"(?:,{json_text.OWN})*+'), F.lit(1))
    found = rows.select("doc", "at", "json", "t", once_a_row(F.array_join(F.regexp_extract_all("t", F.lit(fields), F.lit(0)), ","), "fields")).select(
        "doc", "at", F.upper(text(rf'":{_TO_ID}')).alias("cve_id"), *[named(keys).alias(name) for name, keys in ALIASES.items()], named(WEAKNESS_KEYS).alias("named_weakness"),
        text(rf'":lang":"en"(?:,(?!":value":){json_text.OWN})*+,":value":"(?!")({json_text.CHARS})"').alias("english"),
        text(rf'"(?::value":"(?=CWE-)(?!(?:(?!{unsaid})(?:{json_text.CHAR}))*+{unsaid})|\d{{10}}":"(?=(?i:CWE-)))({json_text.CHARS})').alias("coded_weakness"),
        F.when(F.col("t").contains("cpe:2.3:"), cpes).alias("cpes"), F.slice(_urls(F.col("t")), 1, most).alias("refs"), weaknesses.alias("weaknesses"),
    )
    written = [*ALIASES, "named_weakness", "english", "coded_weakness"]
    told = found.select(*[json_text.said(F.col(x)).alias(x) if x in written else x for x in found.columns])
    of_cpe = lambda x, i: F.replace(json_text.said(F.get(F.split(x, ":"), F.lit(i))), F.lit("_"), F.lit(" "))
    with_vendor = F.filter("cpes", lambda x: ~F.get(F.split(x, ":"), F.lit(3)).isin("*", "-", ""))
    cpe_vendor = F.when(F.col("product").isNull() & F.col("cpes").isNotNull(), of_cpe(F.get(with_vendor, F.lit(0)), 3))
    named_first = F.when(F.upper("named_weakness").startswith("CWE-"), F.col("named_weakness"))
    out = told.select(
        "doc", "at", "cve_id", "title", F.coalesce("english", "description").alias("description"), "severity", "score",
        F.coalesce("product", F.when(F.col("cpes").isNotNull(), of_cpe(F.get("cpes", F.lit(0)), 4))).alias("product"), F.coalesce("vendor", cpe_vendor).alias("vendor"), "versions", "solution", "refs", "weaknesses",
        F.coalesce(named_first, "coded_weakness").alias("weakness"),
    )
    return out.select("doc", "at", *[x.split()[0] for x in SCHEMA.split(", ")])


def _urls(t: Column) -> Column:
    """The urls of lists called references in a text of json_text.own_first(), each once: their texts, and the url of their objects."""
    name = r'"\{:(?i:references|refs)":'
    lists = F.regexp_extract_all(t, F.lit(name + json_text.NUMBERED), F.lit(1))
    members = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(json_text.NUMBERED_MEMBERS), F.lit(1))))
    of = lambda key: rf'\{{(?:(?!":{key}":"){json_text.OWN},)*+":{key}":'
    said = lambda x, where: F.regexp_extract(x, rf'\A\d{{10}}":{where}"(?!")({json_text.CHARS})', 1)
    url = lambda x: F.coalesce(F.nullif(said(x, f"(?:{of('url')})?+"), F.lit("")), said(x, of("URL")))
    placed = F.filter(F.transform(members, lambda x: F.struct(F.substring(x, 1, 10).alias("place"), url(x).alias("url"))), lambda x: x["url"].startswith("http"))
    urls = F.array_distinct(F.transform(F.array_sort(placed), lambda x: json_text.said(x["url"])))
    return F.when(t.rlike(name), urls).otherwise(F.array().cast("array<string>"))


def comments(threads: DataFrame, posts: int = 3, each: int = 4) -> DataFrame:
    """threads (topic, post, at, body) as topic, post, number, author, said, url: of each topic's first posts by their place (at) the first comments, in the order given.

    A body is a list of two listings, of which the second holds the comments; only entries of kind t1 with a text and a link count.
    Deleted authors are null. A body of another shape gives no row.
    """
    place = F.row_number().over(Window.partitionBy("topic").orderBy("at", "post"))
    first = threads.withColumn("place", place).where(F.col("place") <= posts)
    nodes = json_nodes(first.select(F.struct("topic", "post").alias("doc"), "body"))
    # [1].data.children[i] and its data
    child = (F.get("path", F.lit(0)) == 1) & (F.try_element_at("keys", F.lit(2)) == "data") & (F.try_element_at("keys", F.lit(3)) == "children") & F.try_element_at("keys", F.lit(1)).isNull()
    heads = nodes.where((F.size("keys") == 4) & (F.col("kind") == "object")).where(child).where(F.try_element_at("strings", F.lit("kind")) == "t1").select("doc", "path")
    bodies = nodes.where((F.size("keys") == 5) & (F.col("kind") == "object")).where(child & (F.try_element_at("keys", F.lit(5)) == "data"))
    look = lambda key: F.try_element_at(F.col("strings"), F.lit(key))
    told = bodies.select(F.col("doc").alias("thread"), F.slice("path", 1, 4).alias("of"), F.nullif(look("author"), F.lit("[deleted]")).alias("author"), text_functions.bare_text(look("body")).alias("said"), look("permalink").alias("url"))
    kept = told.join(heads, (F.col("thread") == F.col("doc")) & (F.col("of") == F.col("path"))).where("said is not null and url <> ''")
    rank = F.row_number().over(Window.partitionBy("thread").orderBy("of"))
    return kept.withColumn("number", rank).where(F.col("number") <= each).select("thread.topic", "thread.post", "number", "author", "said", "url")


def two_levels(pages: DataFrame, ids: str, links: str, least: int = 3, follow: int = 20) -> DataFrame:
    """pages (url, ids, links) by url: their own ids, and, where they have fewer than least, those of the first pages that they link to.

    Links meet pages by an equi-join on url; of pages of one url the one with the least ids in order counts, so a url that
    many rows share meets one row. Pages without any id give an empty list.
    """
    one = pages.groupBy("url").agg(F.min(F.struct(F.col(ids), F.col(links))).alias("p")).select("url", F.col(f"p.{ids}").alias("own"), F.col(f"p.{links}").alias("to"))
    short = one.where(F.size("own") < least).select("url", F.explode(F.slice("to", 1, follow)).alias("target"))
    met = short.join(one.select(F.col("url").alias("target"), F.col("own").alias("more")), "target").groupBy("url").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("more")))).alias("more"))
    none = F.array().cast("array<string>")
    return one.join(met, "url", "left").select("url", F.array_distinct(F.concat("own", F.coalesce("more", none))).alias("ids"))
