"""Feeds, links and sections of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from advisorium.functions import urls


def page_links(pages: DataFrame) -> DataFrame:
    """One row per page and distinct link target, in order of sight."""
    return pages.select("page_id", "url", F.posexplode(urls.links(F.col("html"))).alias("place", "href"))


def feed_items(feeds: DataFrame, body: str, tag: str = "item") -> DataFrame:
    """One row per feed item with its title, link and day; tags inside texts are stripped, empty texts are null."""
    text = lambda c, t: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?is)<{t}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{t}>", 1), "<[^>]+>", "")), F.lit(""))
    items = feeds.select("*", F.posexplode(F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}[\s>].*?</{tag}>"), F.lit(0))).alias("place", "item"))
    return items.select(*[c for c in feeds.columns if c != body], "place", text("item", "title").alias("title"), text("item", "link").alias("link"), text("item", "pubDate").alias("published"))


def sitemap_entries(sitemaps: DataFrame, body: str) -> DataFrame:
    """One row per url of a sitemap: loc and lastmod (null where it is missing)."""
    entry = F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<url>.*?</url>"), F.lit(0)))
    rows = sitemaps.select(*[c for c in sitemaps.columns if c != body], entry.alias("entry"))
    found = lambda t: F.nullif(F.regexp_extract("entry", rf"(?is)<{t}>\s*(.*?)\s*</{t}>", 1), F.lit(""))
    return rows.withColumn("loc", found("loc")).withColumn("lastmod", found("lastmod")).drop("entry")


def carried_sections(texts: DataFrame, key: str, text: str, labels: dict[str, str], stops: list[str]) -> DataFrame:
    """Lines below a label line belong to the label's field, until another label or a stop line: key, place, field, line."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line")).withColumn("line", F.trim("line"))
    mark = F.lit(None).cast("string")
    for label, field in labels.items():
        mark = F.when(F.lower("line") == label, F.lit(field)).otherwise(mark)
    mark = F.when(F.lower("line").isin(stops), F.lit("")).otherwise(mark)
    order = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("mark", mark).withColumn("field", F.last("mark", ignorenulls=True).over(order))
    return held.where("mark is null and field <> '' and line <> ''").select(key, "place", "field", "line")


def same_page_groups(pages: DataFrame) -> DataFrame:
    """Pages by what makes their urls the same: key, number of urls and the smallest of them."""
    return pages.groupBy(urls.page_key(F.col("url")).alias("page_key")).agg(F.countDistinct("url").alias("n_urls"), F.min("url").alias("first_url"))


def repeat_like_menus(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Whether a text repeats like a menu: at least 8 words of over two letters, the most frequent being 40 % of them.

    Words are counted as rows, so long texts cost their length; texts without such words have no row.
    """
    words = texts.select(key, F.explode(F.filter(F.split(F.lower(text), r"[ \n\t]+"), lambda w: F.length(w) > 2)).alias("word"))
    counted = words.groupBy(key, "word").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("words"), F.max("n").alias("most"))
    return counted.select(key, ((F.col("words") >= 8) & (F.col("most") >= 0.4 * F.col("words"))).alias("menu"))
