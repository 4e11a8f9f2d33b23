"""Queries over dates, cleaning, identifiers, urls, sets and changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advisorium.functions import dates, scoring, text, urls
from advisorium.operators import records as ops
from advisorium.operators import sets
from advisorium.plans.registry import query
from advisorium.plans.text_queries import HOST
from advisorium.sources.tables import NOW, sql, table, vuln_raw

DAY = dt.date(2001, 7, 20)


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in words)


def _holds(column: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{x.lower()}')" for x in marks) + ")"


@query("parsed_times", f"""
SELECT o_orderkey AS id, unnest(['iso', 'stamp', 'english', 'english_full', 'day_first', 'month_number', 'day_number', 'french', 'ago', 'impossible']) AS form,
  unnest([d, d, d, d, d, d, CASE WHEN day(d) <= 12 THEN make_date(year(d)::BIGINT, day(d)::BIGINT, month(d)::BIGINT)::TIMESTAMP ELSE d END, d, TIMESTAMP '{NOW}' - to_hours(day(d)::INTEGER), NULL])::VARCHAR AS at
FROM (SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP AS d FROM orders)""")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    """An order's day in ten renderings, among them an impossible one; slashes are month first if that can be."""
    at = F.to_date("o_orderdate")
    french = F.array(*[F.lit(x) for x in ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")])
    day, year = F.dayofmonth(at).cast("string"), F.year(at).cast("string")
    forms = {
        "iso": F.concat(F.lit("published "), at.cast("string"), F.lit(".")), "stamp": F.concat(at.cast("string"), F.lit("T00:00:00Z")), "english": F.concat(F.date_format(at, "MMM"), F.lit(" "), day, F.lit(", "), year),
        "english_full": F.concat(F.date_format(at, "MMMM"), F.lit(" "), day, F.lit("th "), year), "day_first": F.concat(day, F.lit(" "), F.date_format(at, "MMM"), F.lit(". "), year),
        "month_number": F.date_format(at, "MM/dd/yyyy"), "day_number": F.date_format(at, "dd.MM.yyyy"), "french": F.concat(day, F.lit(" "), F.element_at(french, F.month(at)), F.lit(" "), year),
        "ago": F.concat(day, F.lit(" hours ago")), "impossible": F.concat(F.lit("31 "), F.lit("february "), year),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("said")) for k, v in forms.items()]))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), each.alias("e"))
    return rows.select("id", "e.form", dates.parsed_time(F.col("e.said"), ops.ts(NOW)).cast("string").alias("at"))


@query("date_kinds", sql("SELECT seq, CASE WHEN is_new AND solution IS NULL THEN 'modified' WHEN is_new THEN 'publish' WHEN solution IS NULL THEN 'deadline' ELSE 'plain' END AS kind FROM vuln_raw"))
def date_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Of several phrases before a date the nearest tells its kind."""
    none = F.col("solution").isNull()
    before = F.when(F.col("is_new") & none, "Due date unknown, published once, last updated on ").when(F.col("is_new"), "last updated or rather Published: ").when(none, "created, then due date ").otherwise("seen on ")
    return vuln_raw(spark, d).select("seq", dates.date_kind(before).alias("kind"))


@query("content_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(left(ltrim(b), 1), '[{\\[]') THEN 'json' WHEN starts_with(lower(left(ltrim(b), 2000)), '<?xml') OR contains(lower(left(ltrim(b), 2000)), '<rss') OR contains(lower(left(ltrim(b), 2000)), '<feed') THEN 'xml' ELSE 'html' END AS kind FROM (SELECT html AS b FROM pages UNION ALL SELECT props FROM events UNION ALL SELECT text FROM documents)) GROUP BY kind")
def content_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of pages, events and documents by what they are."""
    none = F.lit(None).cast("string")
    bodies = sets.bag_union([table(spark, d, "pages").select(F.col("html").alias("b")), table(spark, d, "events").select(F.col("props").alias("b")), table(spark, d, "documents").select(F.col("text").alias("b"))])
    return bodies.groupBy(dates.content_kind(F.col("b"), none, none).alias("kind")).agg(F.count("*").alias("n"))


@query("day_named", sql(f"SELECT cve_id, count(*) AS n FROM vuln_raw WHERE published_at::DATE = DATE '{DAY}' GROUP BY cve_id"))
def day_named(spark: SparkSession, d: str) -> DataFrame:
    """Ids whose text names the day, in one of six renderings by source."""
    at = F.col("published_at")
    forms = [F.date_format(at, x) for x in ("yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMMM d yyyy")]
    note = F.concat(F.lit("Bulletin of "), F.element_at(F.array(*forms), (F.pmod("source_id", F.lit(5)) + 1).cast("int")))
    return vuln_raw(spark, d).where(dates.names_day(note, DAY)).groupBy("cve_id").agg(F.count("*").alias("n"))


@query("fresh_rows", sql(f"SELECT vendor, count(*) FILTER (WHERE date_diff('second', collected_at, TIMESTAMP '{NOW}') < 86400 * 14 AND is_new) AS fresh, count(*) AS n FROM vuln_raw GROUP BY vendor"))
def fresh_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows young enough, and of the present version of their rule, to be used again."""
    usable = dates.fresh(F.col("collected_at"), ops.ts(NOW), 24 * 14, F.col("is_new").cast("int"), 1)
    return vuln_raw(spark, d).groupBy("vendor").agg(F.count_if(usable).alias("fresh"), F.count("*").alias("n"))


_BARE = "trim(regexp_replace(replace(replace(replace(regexp_replace(text, '<[a-zA-Z/!][^>]{0,80}>', ' ', 'g'), '&nbsp;', ' '), '&#39;', ''''), '&apos;', ''''), '\\s+', ' ', 'g'))"


@query("clean_descriptions", f"SELECT doc_id, sha256(b) AS digest, length(b)::INTEGER AS n FROM (SELECT doc_id, text, {_BARE} AS b FROM documents) WHERE length(b) >= 40 AND NOT {_holds('text', text.CODE_MARKS)} AND NOT {_holds('b', text.CODE_MARKS + text.UNSHOWN_MARKS)} AND NOT ({_holds('b', text.FRAME_MARKS)} AND length(b) < 200)")
def clean_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Usable descriptions among all texts; code, unshown pages and frames give none."""
    # in a generator, so that the filter and both columns don't clean the text anew
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(text.clean_description(F.col("text")))).alias("b"))
    return rows.where("b is not null").select("doc_id", F.sha2("b", 256).alias("digest"), F.length("b").alias("n"))


@query("clean_fields", sql("SELECT seq, CASE WHEN is_new THEN product END AS product, CASE WHEN solution IS NOT NULL THEN 'Apply update ' || product END AS solution FROM vuln_raw"))
def clean_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a record that are an id's title or a menu become null, tags go."""
    product = F.when(F.col("is_new"), F.concat(F.lit("<b>"), "product", F.lit("</b>"))).otherwise(F.concat("cve_id", F.lit(" - Overview, Insights & Trends")))
    solution = F.when(F.col("solution").isNotNull(), F.concat(F.lit("Apply <i>update</i> "), "product")).otherwise("Services Support Back Support Support Home Support Library")
    return vuln_raw(spark, d).select("seq", text.clean_product(product).alias("product"), text.clean_text(solution).alias("solution"))


@query("decorative_links", f"SELECT page_id, url, (regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') AND NOT regexp_matches(url, '\\?.')) OR regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)/(submit|share|sharer|intent/tweet|shareArticle|feed|rss|wp-json|wp-content|wp-includes|xmlrpc\\.php|tag|category|author)(/|$)') OR NOT coalesce(regexp_matches(url, '^https?://'), false) OR {HOST} IS NULL OR {HOST} IN ({_quoted(urls.FRAME_HOSTS)}) AS decorative FROM pages")
def decorative_links(spark: SparkSession, d: str) -> DataFrame:
    """Urls that belong to a page's frame."""
    return table(spark, d, "pages").select("page_id", "url", urls.decorative(F.col("url")).alias("decorative"))


@query("english_texts", f"SELECT doc_id, length(trim(text)) >= 25 AND len(list_filter(w, lambda x: x IN ({_quoted(text.ENGLISH_WORDS)}))) > len(list_filter(w, lambda x: x IN ({_quoted(text.FRENCH_WORDS)}))) AS english FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\\pL\\pN_]+') AS w FROM documents)")
def english_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text looks English."""
    return table(spark, d, "documents").select("doc_id", text.looks_english(F.col("text")).alias("english"))


@query("folded_words", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z]{12,}')) AS word FROM documents) GROUP BY word")
def folded_words(spark: SparkSession, d: str) -> DataFrame:
    """Long words without their accents, counted."""
    words = F.regexp_extract_all(text.fold_accents(F.lower("text")), F.lit("[a-z]{12,}"), F.lit(0))
    return table(spark, d, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("stop_tokens", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM conversations) WHERE len(list_filter(regexp_split_to_array(lower(token), '[-''’_]'), lambda x: x <> '' AND NOT (strip_accents(x) IN ('the', 'and', 'les', 'des', 'une', 'with') OR regexp_matches(x, '^\\d+$') OR length(x) <= 2))) = 0 GROUP BY token")
def stop_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of messages that carry nothing, compound ones too."""
    tokens = table(spark, d, "conversations").select(F.explode(F.split("text", " ")).alias("token"))
    return tokens.where(text.is_stop_word(F.col("token"), ["the", "and", "les", "des", "une", "with"])).groupBy("token").agg(F.count("*").alias("n"))


@query("last_sentences", "SELECT conv_id, turn, CASE WHEN regexp_matches(t, '[.!?»]$') THEN t WHEN length(k) > 41 THEN k END AS kept FROM (SELECT conv_id, turn, trim(text) AS t, regexp_extract(trim(text), '^(.*\\.)[ \\n]', 1, 's') AS k FROM conversations)")
def last_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Messages up to their last finished sentence."""
    return table(spark, d, "conversations").select("conv_id", "turn", text.last_sentence(F.col("text")).alias("kept"))


@query("french_lists", sql("SELECT cve_id, CASE WHEN len(v) = 1 THEN v[1] ELSE array_to_string(v[1:-2], ', ') || ' et ' || v[-1] END AS listed FROM (SELECT cve_id, list_sort(list(DISTINCT vendor)) AS v FROM vuln_raw GROUP BY cve_id)"))
def french_lists(spark: SparkSession, d: str) -> DataFrame:
    """An id's vendors as a list in words."""
    vendors = vuln_raw(spark, d).groupBy("cve_id").agg(F.array_sort(F.collect_set("vendor")).alias("v"))
    return vendors.select("cve_id", text.french_list(F.col("v")).alias("listed"))


@query("bullet_points", sql(f"SELECT seq, list_filter([product, CASE WHEN NOT is_new THEN 'Needs ' || vendor END], lambda x: x IS NOT NULL AND lower(x) NOT IN ({_quoted([w for x in text.RISK_WORDS.values() for w in x])})) AS points FROM vuln_raw"))
def bullet_points(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a text as points, words of severity dropped."""
    body = F.concat("product", F.lit("; High • "), F.when(F.col("is_new"), "Critique\nlow").otherwise(F.concat(F.lit("Needs "), "vendor", F.lit(". Moyen."))))
    return vuln_raw(spark, d).select("seq", text.bullets(body).alias("points"))


@query("severity_labels", sql("SELECT cvss_score, CASE WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' WHEN cvss_score > 0 THEN 'low' END AS by_score, CASE l_tax WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS by_word, count(*) AS n FROM (SELECT cvss_score, source_id % 5 AS l_tax FROM vuln_raw) GROUP BY ALL"))
def severity_labels(spark: SparkSession, d: str) -> DataFrame:
    """Severities by score and by a word of risk."""
    word = F.element_at(F.array(*[F.lit(x) for x in ("Critique", " Élevé", "modere", "BAS", "inconnu")]), (F.pmod("source_id", F.lit(5)) + 1).cast("int"))
    return vuln_raw(spark, d).groupBy("cvss_score", scoring.severity(F.col("cvss_score")).alias("by_score"), text.risk_severity(word).alias("by_word")).agg(F.count("*").alias("n"))


@query("valid_ids", sql("SELECT seq, NOT is_new AS whole, true AS within, 2 AS distinct_ids, 1 AS advisories FROM vuln_raw"))
def valid_ids(spark: SparkSession, d: str) -> DataFrame:
    """Whole ids against ids within a text, how many distinct ones there are, and of another registry."""
    said = F.when(F.col("is_new"), F.concat("cve_id", F.lit("x"))).otherwise(F.col("cve_id"))
    note = F.concat(F.lower("cve_id"), F.lit(" and "), "cve_id", F.lit(", CVE-1999-0001; GHSA-ab12-cd34-ef56, ghsa-AB12-cd34-ef56"))
    return vuln_raw(spark, d).select("seq", text.is_cve_id(said).alias("whole"), (F.size(text.cve_ids(said)) > 0).alias("within"), F.size(text.cve_ids(note)).alias("distinct_ids"), F.size(text.advisory_ids(note)).alias("advisories"))


@query("cvss_decoded", sql("SELECT seq, ['AV', 'AC', 'C'] AS metrics, CASE WHEN is_new THEN ['N', 'L', 'H'] ELSE ['L', 'H', 'N'] END AS chosen FROM vuln_raw"))
def cvss_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of versions 3 and 4 as one set of metrics; repeated and unknown ones don't count."""
    vector = F.when(F.col("is_new"), "CVSS:3.1/AV:N/AC:L/C:H/C:N/ZZ:Q").otherwise("cvss:4.0/av:l/at:h/vc:n/ac:l/AV:X")
    metrics = scoring.cvss_metrics(vector)
    return vuln_raw(spark, d).select("seq", F.map_keys(metrics).alias("metrics"), F.map_values(metrics).alias("chosen"))


@query("exploit_evidence", sql("SELECT evidence, count(*) AS n FROM (SELECT CASE WHEN solution IS NOT NULL THEN 'kev' WHEN is_new THEN 'poc' END AS evidence FROM vuln_raw) GROUP BY evidence"))
def exploit_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What attests exploitation: a status first, then references."""
    references = F.when(F.col("is_new"), F.array(F.lit("https://a/"), F.lit("https://www.Exploit-DB.com/1"))).otherwise(F.array(F.lit("https://a/")))
    return vuln_raw(spark, d).groupBy(scoring.exploitation(F.col("solution"), references).alias("evidence")).agg(F.count("*").alias("n"))


@query("worst_severities", sql("SELECT cve_id, arg_max(s, r) AS worst FROM (SELECT cve_id, CASE WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' ELSE 'low' END AS s, CASE WHEN cvss_score >= 9 THEN 4 WHEN cvss_score >= 7 THEN 3 WHEN cvss_score >= 4 THEN 2 ELSE 1 END AS r FROM vuln_raw) GROUP BY cve_id"))
def worst_severities(spark: SparkSession, d: str) -> DataFrame:
    """An id's highest severity by rank, not by name; the set has four names at most."""
    return vuln_raw(spark, d).groupBy("cve_id").agg(scoring.worst_severity(F.collect_set(F.upper(scoring.severity(F.col("cvss_score"))))).alias("worst"))


@query("pass_ratios", sql("SELECT seq, CASE WHEN is_new THEN CASE WHEN solution IS NOT NULL THEN 100 ELSE 50 END ELSE CASE WHEN solution IS NOT NULL THEN 50 ELSE 0 END END::INTEGER AS ratio FROM vuln_raw"))
def pass_ratios(spark: SparkSession, d: str) -> DataFrame:
    """The share of determined checks that passed."""
    return vuln_raw(spark, d).select("seq", scoring.pass_ratio([F.col("is_new"), F.col("solution").isNotNull(), F.lit(None).cast("boolean")]).alias("ratio"))


_SIDE = "(SELECT cve_id, min_by(vendor, seq) AS vendor, max(cvss_score) AS score FROM vuln_raw WHERE (collected_at < TIMESTAMP '1998-06-01') = {} GROUP BY cve_id)"


@query("change_labels", sql(f"SELECT n.cve_id, list_filter([CASE WHEN o.vendor <> n.vendor THEN 'Vendor : ' || o.vendor || ' → ' || n.vendor END, CASE WHEN o.score <> n.score THEN 'Score : ' || round(o.score * 10)::BIGINT || ' → ' || round(n.score * 10)::BIGINT END], lambda x: x IS NOT NULL) AS labels FROM {_SIDE.format('true')} o JOIN {_SIDE.format('false')} n ON o.cve_id = n.cve_id"))
def change_labels(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two collections, before and after, in words."""
    rows = vuln_raw(spark, d)
    score = F.bround(F.max("cvss_score") * 10).cast("bigint").cast("string")
    side = lambda early, p: rows.where((F.col("collected_at") < ops.ts("1998-06-01")) == F.lit(early)).groupBy("cve_id").agg(F.min_by("vendor", "seq").alias(f"{p}_vendor"), score.alias(f"{p}_score"))
    both = side(True, "o").join(side(False, "n"), "cve_id")
    labels = F.array(scoring.change_label("Vendor", F.col("o_vendor"), F.col("n_vendor")), scoring.change_label("Score", F.col("o_score"), F.col("n_score")))
    return both.select("cve_id", F.filter(labels, lambda x: x.isNotNull()).alias("labels"))


@query("organisations", f"SELECT org, count(*) AS pages FROM (SELECT coalesce(list_filter(list_reverse(string_split({HOST}, '.'))[2:], lambda x: x <> '' AND x NOT IN ({_quoted(urls.GENERIC_LABELS)}))[1], {HOST}) AS org FROM pages) GROUP BY org")
def organisations(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the organisation that their host names."""
    return table(spark, d, "pages").groupBy(urls.organisation(urls.host(F.col("url"))).alias("org")).agg(F.count("*").alias("pages"))


@query("foreign_references", sql("SELECT seq, source_id % 2 = 0 AS other FROM vuln_raw"))
def foreign_references(spark: SparkSession, d: str) -> DataFrame:
    """References that name another id than the record's."""
    url = F.concat(F.lit("https://registry/"), F.when(F.col("source_id") % 2 == 0, F.concat("cve_id", F.lit("0"))).otherwise(F.lower("cve_id")))
    return vuln_raw(spark, d).select("seq", urls.cites_other_id(url, F.col("cve_id")).alias("other"))


@query("vendor_references", "SELECT page_id, list_filter(hrefs, lambda x: starts_with(lower(x), 'http') AND NOT regexp_matches(lower(x), 'example\\.com'))[1] AS first_link, list_filter(hrefs, lambda x: regexp_matches(x, '(?i)\\.pdf(\\?.*)?$'))[1:5] AS pdfs FROM (SELECT page_id, list_distinct(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS hrefs FROM pages)")
def vendor_references(spark: SparkSession, d: str) -> DataFrame:
    """Of each page the first link that is no aggregator's, and its PDF files."""
    links = urls.links(F.col("html"))
    return table(spark, d, "pages").select("page_id", urls.first_without(links, ["example.com"]).alias("first_link"), urls.pdf_links(F.col("html")).alias("pdfs"))


@query("duplicate_sources", "SELECT key, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, regexp_replace(lower(trim(url)), '/+$', '') AS key FROM pages) GROUP BY key")
def duplicate_sources(spark: SparkSession, d: str) -> DataFrame:
    """Pages by their normalised url."""
    rows = table(spark, d, "pages").select("page_id", urls.publication_key(F.col("url"), F.lit(None).cast("string")).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("page_lines", "SELECT page_id, len(l)::INTEGER AS n, sha256(array_to_string(l, chr(10))) AS digest FROM (SELECT page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/dt|/dd|/td|/th|/section|/article)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages)")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of pages."""
    rows = table(spark, d, "pages").select("page_id", text.text_lines(F.col("html")).alias("l"))
    return rows.select("page_id", F.size("l").alias("n"), F.sha2(F.array_join("l", "\n"), 256).alias("digest"))


@query("json_recovered", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE props END AS object FROM events")
def json_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Objects in chatty answers; a broken one gives none."""
    said = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("{ no json "), "props")).otherwise(F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```")))
    return table(spark, d, "events").select("event_id", text.json_object(said).alias("object"))


@query("brand_vocabulary", "SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS word FROM part) WHERE length(word) >= 4 AND word NOT IN ('blue', 'steel')")
def brand_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Words of valid names without stop words."""
    return sets.vocabulary(table(spark, d, "part"), "p_name", ["blue", "steel"])


@query("scope_algebra", sql("SELECT cve_id, list_sort(list_distinct(list_concat(a, b))) AS either, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_new, list_sort(list_filter(a, lambda x: list_contains(b, x))) AS common, list_sort(a) = list_sort(b) AS same FROM (SELECT cve_id, coalesce(list(DISTINCT vendor) FILTER (WHERE is_new), []) AS a, coalesce(list(DISTINCT vendor) FILTER (WHERE NOT is_new), []) AS b FROM vuln_raw GROUP BY cve_id)"))
def scope_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Union, difference, intersection and equality of an id's vendors before and after."""
    both = vuln_raw(spark, d).groupBy("cve_id").agg(F.collect_set(F.when(F.col("is_new"), F.col("vendor"))).alias("a"), F.collect_set(F.when(~F.col("is_new"), F.col("vendor"))).alias("b"))
    return both.select("cve_id", F.array_sort(sets.ordered_union(F.col("a"), F.col("b"))).alias("either"), F.array_sort(F.array_except("a", "b")).alias("only_new"), F.array_sort(F.array_intersect("a", "b")).alias("common"), sets.same_set(F.col("a"), F.col("b")).alias("same"))


@query("collected_union", "SELECT kind, count(*) AS n, count(nation) AS with_nation FROM (SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier UNION ALL SELECT 'part', NULL FROM part) GROUP BY kind")
def collected_union(spark: SparkSession, d: str) -> DataFrame:
    """All collectors' rows as one bag, columns that one lacks being null."""
    parts = [table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")), table(spark, d, "part").select(F.lit("part").alias("kind"))]
    return sets.bag_union(parts).groupBy("kind").agg(F.count("*").alias("n"), F.count("nation").alias("with_nation"))


@query("recipients_appended", "SELECT n_name AS email, 'stored' AS origin FROM nation WHERE n_nationkey < 10 UNION ALL SELECT min(lower(n_name)), 'new' FROM nation WHERE n_nationkey >= 5 AND lower(n_name) NOT IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 10) GROUP BY lower(n_name)")
def recipients_appended(spark: SparkSession, d: str) -> DataFrame:
    """Recipients appended once, whatever the case they are written in."""
    nation = table(spark, d, "nation")
    stored = nation.where("n_nationkey < 10").select(F.col("n_name").alias("email"), F.lit("stored").alias("origin"))
    more = nation.where("n_nationkey >= 5").select(F.lower("n_name").alias("email"), F.lit("new").alias("origin"))
    return sets.appended_once(stored, more.unionByName(more), "email")


_SCOPE = "(SELECT cve_id, list(DISTINCT product) AS scopes, list(DISTINCT source_name) AS sources, min(published_at) AS f, bool_or(is_new) AS c FROM vuln_raw WHERE (collected_at < TIMESTAMP '1998-06-01') = {} GROUP BY cve_id)"


@query("scope_merged", sql(f"SELECT coalesce(n.cve_id, o.cve_id) AS cve_id, list_sort(list_distinct(list_concat(coalesce(o.scopes, []), coalesce(n.scopes, [])))) AS scopes, list_sort(list_distinct(list_concat(coalesce(o.sources, []), coalesce(n.sources, [])))) AS sources, least(n.f, o.f)::DATE::VARCHAR AS first_published, coalesce(n.c, false) OR coalesce(o.c, false) AS confirmed FROM {_SCOPE.format('true')} o FULL JOIN {_SCOPE.format('false')} n ON o.cve_id = n.cve_id"))
def scope_merged(spark: SparkSession, d: str) -> DataFrame:
    """Scopes and sources as unions, the earlier publication, confirmed if either side is."""
    rows = vuln_raw(spark, d)
    side = lambda early: rows.where((F.col("collected_at") < ops.ts("1998-06-01")) == F.lit(early)).groupBy("cve_id").agg(F.collect_set("product").alias("scopes"), F.collect_set("source_name").alias("sources"), F.min("published_at").alias("first_published"), F.max("is_new").alias("confirmed"))
    return sets.scope_merge(side(True), side(False), "cve_id").withColumn("first_published", F.to_date("first_published").cast("string"))


@query("product_list", "SELECT p_partkey AS id, p_type AS domain, p_name AS name FROM part WHERE p_size > 5 AND lower(p_brand) = 'brand#11' AND (regexp_matches(p_name, '(?i)b[lr]') OR regexp_matches(p_type, '(?i)b[lr]') OR regexp_matches(p_brand, '(?i)b[lr]')) ORDER BY p_type, p_name")
def product_list(spark: SparkSession, d: str) -> DataFrame:
    """The product list by state, vendor and a pattern, by domain and name."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("domain"), (F.col("p_size") > 5).alias("enabled"), F.array("p_type").alias("aliases"))
    return sets.list_filtered(rows, vendor="BRAND#11", enabled=True, words="b[lr]").orderBy("domain", "name", "id").select("id", "domain", "name")


@query("active_groups", sql("SELECT product, count(*) AS n FROM vuln_raw WHERE product IN (SELECT p_name FROM part WHERE p_size > 48) GROUP BY product"))
def active_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of products that are in use."""
    names = table(spark, d, "part").where("p_size > 48").select(F.col("p_name").alias("product")).distinct()
    return vuln_raw(spark, d).groupBy("product").agg(F.count("*").alias("n")).join(ops.small(names), "product", "left_semi")


@query("ranked_groups", sql("SELECT domain, worst, n, row_number() OVER (ORDER BY worst DESC, n DESC, domain)::INTEGER AS place FROM (SELECT domain, max(CASE WHEN cvss_score >= 9 THEN 4 WHEN cvss_score >= 7 THEN 3 WHEN cvss_score >= 4 THEN 2 ELSE 1 END)::INTEGER AS worst, count(DISTINCT cve_id) AS n FROM vuln_raw GROUP BY domain)"))
def ranked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by their worst rank, then by their number of ids; one row a domain is numbered."""
    groups = vuln_raw(spark, d).groupBy("domain").agg(F.max(scoring.severity_rank(scoring.severity(F.col("cvss_score")))).alias("worst"), F.countDistinct("cve_id").alias("n"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc("worst"), F.desc("n"), "domain")))


@query("new_publications", sql("SELECT vendor, count(*) AS n FROM vuln_raw WHERE cve_status IS NOT NULL OR published_at > TIMESTAMP '2001-06-01' GROUP BY vendor"))
def new_publications(spark: SparkSession, d: str) -> DataFrame:
    """published since the last run; without a date it counts as new."""
    published = F.when(F.col("cve_status").isNull(), F.col("published_at"))
    return vuln_raw(spark, d).where(F.coalesce(published > ops.ts("2001-06-01"), F.lit(True))).groupBy("vendor").agg(F.count("*").alias("n"))


@query("result_rows", sql("SELECT cve_id, left(coalesce(nullif(max(solution), ''), array_to_string(list_sort(list(DISTINCT product)), ', ')), 80) AS product, list_sort(list(DISTINCT vendor))[1:4] AS refs, array_to_string(list_sort(list(DISTINCT source_name)), ', ') AS source FROM vuln_raw GROUP BY cve_id"))
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """A result's product or its affected ones in 80 characters, four references, and all its sources' names."""
    several = F.array_join(F.array_sort(F.collect_set("product")), ", ")
    return vuln_raw(spark, d).groupBy("cve_id").agg(
        F.left(F.coalesce(F.nullif(F.max("solution"), F.lit("")), several), F.lit(80)).alias("product"), F.slice(F.array_sort(F.collect_set("vendor")), 1, 4).alias("refs"), F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("source"),
    )
