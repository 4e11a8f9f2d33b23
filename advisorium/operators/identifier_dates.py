"""Dates of identifiers in bodies of JSON, XML and HTML: by field, by entry, and by nearness in the visible text.

In a text, ids and dates are one ordered list of marks, each a row. A date can only belong to the last id before it and to
the first id after it, which are running values over the marks; so no id is ever paired with all dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advisorium.functions import dates, text
from advisorium.functions.columns import once
from advisorium.operators.json_nodes import json_nodes, levels_of

#: Keys of publication and of change in order of preference, keys that hold an id, and tags of an entry's date (fixed values).
PUBLISHED_KEYS = ["publisheddate", "datepublished", "published", "date_published", "pubdate", "dateadded", "date_added", "created", "datecreated", "date", "dc:date", "disclosuredate", "releasedate"]
MODIFIED_KEYS = ["lastmodified", "datemodified", "modified", "updated", "dateupdated"]
ID_KEYS = ["cveid", "cve_id", "cve", "id", "name", "identifier"]
LINKED_KEYS = ["name", "headline", "identifier", "about", "@id"]
XML_TAGS = ["pubdate", "published", "dc:date", "updated", "date", "lastbuilddate"]
#: How far before and after an id its date may stand, and how much before a date tells what it is (fixed values).
BEFORE, AFTER, CUE = 120, 1400, 28
ID = r"CVE-\d{4}-\d{4,}"
#: Dates as they are written (fixed patterns).
DATE = r"\b\d{4}-\d{2}-\d{2}(?!\d)|\b\d{1,2}[/.]\d{1,2}[/.]\d{4}\b|\b\d{1,2}\s+[A-Za-zàâçéèêëîïôûùüÿ]+\s+\d{4}\b|\b[A-Za-z]+\s+\d{1,2},?\s+\d{4}\b"


def any_day(said: Column) -> Column:
    """The first date of a text as YYYY-MM-DD: ISO, numbers with slashes or points, named months, also short English ones; null if it is no day."""
    iso = F.regexp_extract(said, r"\b(\d{4}-\d{2}-\d{2})(?!\d)", 1)
    numbers = r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b"
    part = lambda p, i: F.regexp_extract(said, p, i)
    day = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date").cast("string")
    first, second = r"\b(\d{1,2})(?:er)?\s+(\p{L}{3,})\.?\s+(\d{4})\b", r"\b(\p{L}{3,})\.?\s+(\d{1,2}),?\s+(\d{4})\b"
    month = lambda p, i: dates.month_number(part(p, i)).cast("string")
    named = F.coalesce(F.when(month(first, 2).isNotNull(), day(part(first, 3), month(first, 2), part(first, 1))), F.when(month(second, 1).isNotNull(), day(part(second, 3), month(second, 1), part(second, 2))))
    found = F.coalesce(iso.try_cast("date").cast("string"), F.when(part(numbers, 3) != "", day(part(numbers, 3), part(numbers, 2), part(numbers, 1))), named)
    return once(found, lambda x: F.when(F.left(x, F.lit(4)).between("1900", "2100"), x))


def first_of(texts: Column) -> Column:
    """The first day among texts, in their order."""
    return F.get(F.filter(F.transform(texts, any_day), lambda x: x.isNotNull()), F.lit(0))


def preferred(members: str, keys: list[str]) -> Column:
    """The values of a map under some keys, in any case, in order of the keys."""
    order = F.array(*[F.lit(k) for k in keys])
    own = F.filter(F.map_entries(members), lambda e: F.array_contains(order, F.lower(e["key"])))
    return F.transform(F.array_sort(F.transform(own, lambda e: F.struct(F.array_position(order, F.lower(e["key"])).alias("at"), e["value"].alias("value")))), lambda x: x["value"])


def _merged(found: DataFrame, order: list[str]) -> DataFrame:
    """doc, cve, published, modified: of each id the first row, and the first with a published date instead where that one has none."""
    ranked = found.groupBy("doc", "cve").agg(F.min_by(F.struct("published", "modified"), F.struct(*order)).alias("first"), F.min_by(F.struct("published", "modified"), F.when(F.col("published").isNotNull(), F.struct(*order))).alias("dated"))
    return ranked.select("doc", "cve", F.coalesce("dated", "first").alias("d")).select("doc", "cve", "d.published", "d.modified")


def json_dates(bodies: DataFrame, levels: int | None = None) -> DataFrame:
    """bodies (doc, body) of JSON as doc, cve, published, modified: each object with an id under one of its own keys, in depth-first order.

    levels is the depth of the deepest body, or more, where that is known already.
    """
    objects = json_nodes(bodies.select("doc", "body"), levels=levels).where("kind = 'object'")
    cve = F.get(F.filter(F.transform(preferred("strings", ID_KEYS), lambda x: F.upper(F.regexp_extract(x, f"(?i){ID}", 0))), lambda x: x != ""), F.lit(0))
    first_day = lambda keys: first_of(preferred("scalars", keys))
    keyed = objects.select("doc", "path", "scalars", F.explode(F.array(cve)).alias("cve")).where("cve is not null")
    found = keyed.select("doc", "path", "cve", first_day(PUBLISHED_KEYS).alias("published"), first_day(MODIFIED_KEYS).alias("modified"))
    return _merged(found, ["path"])


def xml_dates(bodies: DataFrame) -> DataFrame:
    """bodies (doc, body) of feeds as doc, cve, published, modified: of each item or entry the first id and the first tag that holds a date."""
    entries = F.concat(*[F.regexp_extract_all("body", F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"), F.lit(0)) for tag in ("item", "entry")])
    each = bodies.select("doc", F.posexplode(entries).alias("at", "entry"))
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("entry", rf"(?is)<\Q{name}\E\b[^>]*>(.*?)</\Q{name}\E>", 1)), F.lit(""))
    cve = F.nullif(F.upper(F.regexp_extract("entry", f"(?i){ID}", 0)), F.lit(""))
    named = each.select("doc", "at", "entry", F.explode(F.array(cve)).alias("cve")).where("cve is not null")
    found = named.select("doc", "at", "cve", first_of(F.array(*[tag(x) for x in XML_TAGS])).alias("published"), first_of(F.array(F.coalesce(tag("updated"), tag("modified")))).alias("modified"))
    return _merged(found, ["at"])


def _blocks(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def blocks_of(bodies: DataFrame) -> DataFrame:
    """bodies (doc, body) of HTML as doc, block, body: their blocks of linked data."""
    return bodies.select("doc", F.posexplode(_blocks(F.col("body"))).alias("block", "body"))


def linked_dates(bodies: DataFrame, levels: int | None = None) -> DataFrame:
    """bodies (doc, body) of HTML as doc, cve, published, modified by their blocks of linked data, and the members of a block's @graph.

    levels is the depth of the deepest block, or more, where that is known already.
    """
    blocks = blocks_of(bodies)
    nodes = json_nodes(blocks.select(F.struct("doc", "block").alias("doc"), "body"), levels=levels).where("kind = 'object'")
    # the block itself, a member of its list, or of its own or such a member's @graph
    names = F.filter("keys", lambda k: k.isNotNull())
    inner = F.try_element_at("keys", F.lit(-1)).isNull() & (F.size("keys") <= 3)
    top = (F.size("keys") == 0) | (inner & ((F.size(names) == 0) & (F.size("keys") == 1) | (F.size(names) == 1) & (names[0] == "@graph") & (F.try_element_at("keys", F.lit(-2)) == "@graph")))
    look = lambda key: F.try_element_at(F.col("scalars"), F.lit(key))
    blob = F.concat_ws(" ", *[F.coalesce(look(k), F.get_json_object("json", f"$['{k}']")) for k in LINKED_KEYS])
    cve = F.nullif(F.upper(F.regexp_extract(blob, f"(?i){ID}", 0)), F.lit(""))
    named = nodes.where(top).select("doc", "path", "scalars", F.explode(F.array(cve)).alias("cve")).where("cve is not null")
    found = named.select("doc.doc", "doc.block", "path", "cve", first_of(F.array(look("datePublished"), look("dateCreated"))).alias("published"), first_of(F.array(look("dateModified"))).alias("modified"))
    return _merged(found, ["block", "path"])


def marks(texts: DataFrame) -> DataFrame:
    """texts (doc, said) as doc, k, at, until, mark, before: every id and date of a text with its number and place, and what stands before it, by running lengths."""
    pattern = rf"(?i:{ID})|{DATE}"
    pieces = texts.select("doc", "said", F.regexp_extract_all("said", F.lit(pattern), F.lit(0)).alias("found"), F.split("said", pattern, -1).alias("gaps"))
    each = pieces.select("doc", F.posexplode(F.arrays_zip(F.col("gaps"), F.col("found"))).alias("k", "z")).select("doc", "k", F.col("z.gaps").alias("gap"), F.col("z.found").alias("mark"))
    rows = Window.partitionBy("doc").orderBy("k")
    ends = F.sum(F.length("gap") + F.coalesce(F.length("mark"), F.lit(0))).over(rows)
    # what stands before a mark may reach over the mark before it
    before = F.right(F.concat(F.coalesce(F.lag("gap").over(rows), F.lit("")), F.coalesce(F.lag("mark").over(rows), F.lit("")), F.col("gap")), F.lit(CUE))
    return each.select("doc", "k", "mark", ends.alias("until"), before.alias("before")).where("mark is not null").withColumn("at", F.col("until") - F.length("mark"))


def near_dates(texts: DataFrame) -> DataFrame:
    """texts (doc, said) as doc, cve, published: for each id the date that says when it was published.

    A date counts up to AFTER characters after an id and before the next one, or up to BEFORE characters before it and after the
    last one. Dates said to be of publication come before plain ones, those after an id before those before it, then the nearest.
    Dates said to be deadlines or changes never count. Of an id's sightings the first that has a date counts.
    """
    own = marks(texts)
    is_id = F.col("mark").rlike(f"^(?i:{ID})$")
    # in the order in which marks() has sorted them already
    rows = Window.partitionBy("doc").orderBy("k")
    back, ahead = rows.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(is_id, F.struct("at", "until"))
    placed = own.select("doc", "at", "mark", "before", is_id.alias("is_id"), F.last(place, ignorenulls=True).over(back).alias("last"), F.last(place, ignorenulls=True).over(ahead).alias("next"))
    # ids as they are, and one row per day that counts: the expressions stand in a generator, so that they are not copied into filters
    told = F.transform(F.array("mark"), lambda m: F.struct(any_day(m).alias("day"), dates.date_kind(F.col("before")).alias("kind")))
    days = F.filter(told, lambda x: x["day"].isNotNull() & x["kind"].isin("publish", "plain"))
    each = placed.select("doc", "at", "mark", "is_id", "last", "next", F.explode(F.when(F.col("is_id"), F.array(F.lit(None).cast("struct<day: string, kind: string>"))).otherwise(days)).alias("t")).select("doc", "at", "mark", "is_id", "last", "next", "t.*")
    plain, none = (F.col("kind") == "plain").cast("int"), F.lit(None).cast("string")
    dated = lambda of, rank, far: F.struct(of.alias("of"), none.alias("cve"), F.struct(rank.alias("rank"), far.alias("far"), F.col("day")).alias("b"))
    own_row = F.when(F.col("is_id"), F.struct(F.col("at").alias("of"), F.upper("mark").alias("cve"), F.lit(None).cast("struct<rank: int, far: bigint, day: string>").alias("b")))
    after = F.when(~F.col("is_id") & (F.col("at") < F.col("last.at") + AFTER), dated(F.col("last.at"), plain, F.col("at") - F.col("last.at")))
    prior = F.when(~F.col("is_id") & (F.col("at") >= F.col("next.at") - BEFORE), dated(F.col("next.at"), plain + 2, F.col("next.at") - F.col("at")))
    # an id and the days that count for it meet by its place, where they are: no part of the texts is read anew to be joined
    claims = each.select("doc", F.explode(F.array_compact(F.array(own_row, after, prior))).alias("c")).select("doc", "c.*")
    best = F.when(F.col("doc").isNotNull(), F.min("b").over(Window.partitionBy("doc", "of")))  # without a doc, nothing belongs to an id
    met = claims.select("doc", "of", "cve", best.alias("b")).where("cve is not null")
    return met.groupBy("doc", "cve").agg(F.min_by("b.day", F.when(F.col("b").isNotNull(), F.col("of"))).alias("published"))


def identifier_dates(bodies: DataFrame) -> DataFrame:
    """bodies (doc, body, content_type, method) as doc, cve, published, modified, found.

    The body's kind picks the way: JSON and feeds by their fields, and as HTML where those give no id at all; HTML by linked data, then
    by nearness in the visible text for ids that have no published date there. doc must be unique; null bodies give nothing.
    """
    told = bodies.where("body is not null").select("doc", "body", dates.content_kind(F.col("body"), F.col("content_type"), F.col("method")).alias("kind"))
    # the depths of JSON and of all bodies' blocks, for which no body need be told from the others, in one reading
    blocks = F.transform(_blocks(F.col("body")), lambda x: F.struct(F.lit("block").alias("kind"), x.alias("body")))
    texts = told.select(F.explode(F.concat(F.when(F.col("kind") == "json", F.array(F.struct("kind", "body"))).otherwise(F.array()), blocks)).alias("t")).select("t.*")
    levels = levels_of(texts, by="kind")
    by_json = json_dates(told.where("kind = 'json'"), levels.get("json", 0)).withColumn("found", F.lit("api"))
    by_xml = xml_dates(told.where("kind = 'xml'")).withColumn("found", F.lit("rss"))
    done = by_json.select("doc").unionAll(by_xml.select("doc")).distinct()
    pages = told.join(done, "doc", "left_anti").select("doc", "body")
    linked = linked_dates(pages, levels.get("block", 0)).withColumn("found", F.lit("json_ld"))
    near = near_dates(pages.select("doc", F.regexp_replace("body", "<[^>]+>", " ").alias("said"))).select(F.col("doc").alias("n_doc"), F.col("cve").alias("n_cve"), F.col("published").alias("n_published"))
    both = linked.join(near, (F.col("doc") == F.col("n_doc")) & (F.col("cve") == F.col("n_cve")), "full")
    html = both.select(F.coalesce("doc", "n_doc").alias("doc"), F.coalesce("cve", "n_cve").alias("cve"), F.coalesce("published", "n_published").alias("published"), "modified", F.coalesce("found", F.lit("scraping")).alias("found"))
    return by_json.unionByName(by_xml).unionByName(html)


def published_today(found: DataFrame, day: str) -> DataFrame:
    """By doc of identifier_dates(): its ids, those with a date, those published on a day, whether there are any, and its latest date."""
    today = F.count_if(F.col("published") == day)
    return found.groupBy("doc").agg(F.count("*").alias("total"), F.count("published").alias("dated"), today.alias("today"), (today > 0).alias("published_today"), F.max("published").alias("latest"))
