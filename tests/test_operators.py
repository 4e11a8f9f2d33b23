"""Behaviour of record operators on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from advisorium.functions import scoring, text, urls
from advisorium.operators import pages, records, sets
from advisorium.plans import catalogue


def test_missing_status_is_kept(spark):
    rows = spark.createDataFrame([("a", None), ("b", "rejected"), ("c", "ok")], "cve_id string, cve_status string")
    assert {r.cve_id for r in records.not_rejected(rows).collect()} == {"a", "c"}


def test_inverted_period_is_an_error():
    with pytest.raises(ValueError, match="ends before"):
        records.period("2001-02-01", "2001-01-01")


def test_severity_bounds(spark):
    rows = spark.createDataFrame([(9.0,), (8.9,), (7.0,), (4.0,), (3.9,), (None,)], "s double")
    assert [r[0] for r in rows.select(scoring.severity(F.col("s"))).collect()] == ["critical", "high", "high", "medium", "low", None]


def test_first_filled_value_wins_whatever_the_order_of_rows(spark):
    rows = spark.createDataFrame([("x", "3", "late"), ("x", "1", None), ("x", "2", "early")], "cve_id string, seq string, vendor string")
    assert rows.groupBy("cve_id").agg(records.first_filled("vendor")).collect()[0].vendor == "early"


def test_field_changes_tells_the_four_states(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "k string, v int")
    assert {r.k: (r.status, r.changes) for r in records.field_changes(old, new, "k", ["v"]).collect()} == {"a": ("unchanged", ""), "b": ("updated", "v"), "c": ("removed", ""), "d": ("new", "")}


def test_ids_slugs_and_tags(spark):
    row = spark.range(1).select(
        text.cve_ids(F.lit("see CVE-2024-1234, cve-2024-1234 and CVE-2023-99999")).alias("ids"), text.slug(F.lit("--Acme (R) Server 2.0--")).alias("slug"),
        text.strip_tags(F.lit("<p>a &lt; b</p><script>x()</script>  c")).alias("bare"), text.strip_qualifier(F.lit("Server (beta)")).alias("name"),
    ).first()
    assert row.ids == ["CVE-2024-1234", "CVE-2023-99999"]
    assert (row.slug, row.bare, row.name) == ("acme-r-server-2-0", "a < b c", "Server")


def test_hosts_and_sites(spark):
    row = spark.range(1).select(
        urls.host(F.lit("HTTPS://user@Www.Example.co.uk:8080/a?b")).alias("h"), urls.registrable(F.lit("www.example.co.uk")).alias("r"), urls.host(F.lit("nothing")).alias("none"),
        urls.same_site(F.lit("www.example.com"), F.lit("docs.example.com")).alias("under"), urls.same_site(F.lit("notexample.com"), F.lit("example.com")).alias("other"),
    ).first()
    assert (row.h, row.r, row.none, row.under, row.other) == ("www.example.co.uk", "example.co.uk", None, True, False)


def test_alias_match_needs_word_bounds(spark):
    products = spark.createDataFrame([("Blue Server",), ("-Blue!",), ("...",)], "name string")
    notes = spark.createDataFrame([(1, "the blue server runs"), (2, "bluebird"), (3, "Blue! blue"), (4, None)], "id int, note string")
    assert {(r.id, r.name) for r in records.alias_match(notes, products, "note").collect()} == {(1, "Blue Server"), (1, "-Blue!"), (3, "-Blue!")}


def test_feed_items_and_sections(spark):
    feed = spark.createDataFrame([(1, "<rss><item><title><![CDATA[<b>T</b>]]></title><link>u</link></item><item><title></title></item></rss>")], "id int, body string")
    assert [(r.place, r.title, r.link, r.published) for r in pages.feed_items(feed, "body").orderBy("place").collect()] == [(0, "T", "u", None), (1, None, None, None)]
    note = spark.createDataFrame([(1, "x\nImpact\nhigh\n\nwide\nContact\nme")], "id int, t string")
    assert [(r.field, r.line) for r in pages.carried_sections(note, "id", "t", {"impact": "impact"}, ["contact"]).orderBy("place").collect()] == [("impact", "high"), ("impact", "wide")]


def test_sections_carry_over_all_lines_and_turns(spark, tmp_path):
    turns = [(1, 0, "system", "be brief\nvery"), (1, 1, "user", "one\n\n two "), (1, 2, "assistant", "three\nfour\nUser\nfive"), (2, 0, "assistant", "six\nsystem\nlost"), (2, 1, "user", "seven")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalogue.QUERIES["section_carry_turns"](spark, str(tmp_path)).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place, r.field, r.line) for r in got] == [
        (1, 4, "user", "one"), (1, 6, "user", "two"), (1, 8, "assistant", "three"), (1, 9, "assistant", "four"), (1, 11, "user", "five"),
        (2, 1, "assistant", "six"), (2, 5, "user", "seven"),
    ]


def test_failure_streaks(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("fffsffs")] + [(2, 0, "s")], "k int, t int, x string")
    assert {r.k: (r.longest, r["last"]) for r in records.failure_streaks(rows, "k", "t", "t", F.col("x") == "f").collect()} == {1: (3, 0), 2: (0, 0)}


def test_the_product_of_the_highest_score_by_number(spark):
    rows = spark.createDataFrame([("x", 9.8, "1", "low"), ("x", 10.0, "2", "top")], "cve_id string, cvss_score double, seq string, product string")
    assert rows.groupBy("cve_id").agg(F.max_by("product", F.struct("cvss_score", "seq")).alias("p")).first().p == "top"


def test_set_operators(spark):
    stored = spark.createDataFrame([("A@x", 1)], "email string, n int")
    more = spark.createDataFrame([("a@X ", 2), ("b@x", 3), ("B@x", 4), (None, 5)], "email string, n int")
    assert sorted((r.email, r.n) for r in sets.appended_once(stored, more, "email").collect()) == [("A@x", 1), ("B@x", 4)]
    old = spark.createDataFrame([("k", ["a"], ["s"], "2001-02-01", False), ("o", ["z"], [], None, True)], "id string, scopes array<string>, sources array<string>, first_published string, confirmed boolean")
    new = spark.createDataFrame([("k", ["b", "a"], ["s", "t"], "2001-01-01", None), ("n", [], ["u"], "2002-01-01", None)], old.schema)
    got = {r.id: (r.scopes, r.sources, r.first_published, r.confirmed) for r in sets.scope_merge(old, new, "id").collect()}
    assert got == {"k": (["a", "b"], ["s", "t"], "2001-01-01", False), "o": (["z"], [], None, True), "n": ([], ["u"], "2002-01-01", False)}
    lists = spark.createDataFrame([(["a", "b"], ["b", "a", "a"]), (["a"], ["b"])], "a array<string>, b array<string>")
    assert [(r.u, r.s) for r in lists.select(sets.ordered_union(F.col("a"), F.col("b")).alias("u"), sets.same_set(F.col("a"), F.col("b")).alias("s")).collect()] == [(["a", "b"], True), (["a", "b"], False)]
