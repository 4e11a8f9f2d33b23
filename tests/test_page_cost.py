"""Pages of advisories are read once for what several expressions ask of them, and odd pages give what they gave before."""

from pyspark.sql import functions as F

from advisorium.functions import advisories


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def told(spark, *pages):
    rows = spark.createDataFrame([(i, p, "http://portal.example/x") for i, p in enumerate(pages)], "id int, html string, url string").coalesce(1)
    return advisories.advisories(rows, F.lit("2024-01-01").cast("timestamp_ntz")).orderBy("id").collect()


def test_lists_that_are_asked_again_are_made_once(spark):
    rows = spark.createDataFrame([(["a"], "p")], "lines array<string>, page string")
    assert plan_of(rows.select(advisories.sections(F.col("lines")).alias("x"))).count(":+$") == 1
    assert plan_of(rows.select(advisories.paragraph(F.col("lines")).alias("x"))).count("transform(lines#") == 1
    assert plan_of(rows.select(advisories.page_ids(F.col("page")).alias("x"))).count("regexp_extract_all") == 2
    assert plan_of(rows.select(advisories.page_ids(F.col("page")).alias("x"))).count("lower(") == 1


def test_pages_are_only_searched_for_what_they_hold(spark):
    rows = spark.createDataFrame([("a",)], "p string")
    page = F.col("p")
    found = plan_of(rows.select(advisories.labelled(page, advisories.folded(page), advisories.pairs(page), ["solution"]).alias("x")))
    assert "solution:" in found and "array_contains" in found and "<dt" in found.replace("(?is)<dt", "") and "<td" in found.replace(r"\s*<td", "")


def test_labels_are_met_however_they_end(spark):
    pages = ["<b>Vendor</b> Acme<br>", "<b>VENDOR \n : </b> Acme<br>", "<b>Vendor\t:</b>\nAcme</p>", "Vendor :Acme\n", "a vendor Acme", "<dt> Vendor\n:</dt><dd>Acme</dd>", "<dt>Vendor</dt> no <dd>Acme</dd>", "<TD>vendor</TD>\n<TD>Acme</TD>", "<dl><dt>Vendor</dt><dd></dd><dt>Vendor</dt><dd>Acme</dd></dl>", "", None]
    assert [r.vendor for r in told(spark, *pages)] == ["Acme", "Acme", "Acme", "Acme", None, "Acme", "no Acme", "Acme", None, None, None]


def test_ids_after_labels_and_numbers_of_portals(spark):
    far = "x" * 1600
    pages = ["<p>CVE-2020-0001</p>identifiers: none " + far + " CVE : cve-2020-0002", "External Identifiers CVE-2020-0003 CVE-2020-0003" + far + "CVE-2020-0004", "CVE" + far + "CVE-2020-0005 and cve-2020-0006", "no id", "tunCERT / VULN.2026-12 CVE", "certain vulns", None]
    found = told(spark, *pages)
    assert [r.cves for r in found] == [["CVE-2020-0001"], ["CVE-2020-0003"], ["CVE-2020-0005", "CVE-2020-0006"], [], [], [], []]
    assert [r.advisory_id for r in found] == [None, None, None, None, "tunCERT/VULN.2026-12", None, None]


def test_lines_links_and_paragraphs_of_odd_pages(spark):
    long = "a line of more than forty characters in all, here it is"
    pages = [f"<h2>Impact::</h2><p>one</p><h2>Impact : </h2><h2>Risque</h2><p>two</p><p>{long}</p><p>Accueil:</p><p>Refer:</p><a href='HTTP://a.example'>x</a><a href='http://u@A.example./y'>y</a><a href='http://portal.example/z'>z</a><a href='http://www.facebook.com/'>f</a><a href='http://'>n</a>", "<p>Refer</p>" + long]
    one, two = told(spark, *pages)
    assert (one.impact, one.description, one.references) == ("one", long, ["http://u@A.example./y", "http://"])
    assert (two.impact, two.description, two.references) == (None, None, [])
    rows = spark.createDataFrame([(None,), ([],), ([None, long],), ([long, "x", "REFER :"],), (["Refer", long + long],)], "lines array<string>").coalesce(1)
    assert [r.p for r in rows.select(advisories.paragraph(F.col("lines")).alias("p")).collect()] == [None, None, None, long, long + long]
    assert [r.s and [tuple(x) for x in r.s] for r in rows.select(advisories.sections(F.col("lines")).alias("s")).collect()] == [None, [], [], [], [("advisory_id", [long + long])]]
    ends = spark.createDataFrame([(["Impact:\u2028", "one", "Solution\u2028:", "two", "\u00c9diteur", "ACCUEIL::", "three"],)], "lines array<string>")
    assert [tuple(x) for x in ends.select(advisories.sections(F.col("lines")).alias("s")).first().s] == []
