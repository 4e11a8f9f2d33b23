"""Pages, dates by identifier, nested JSON, the catalogue, names, audits and grounding on nulls, ties, repeats and empty inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from advisorium.functions import advisories, official
from advisorium.operators import audits, catalogue, grounding, identifier_dates, json_nodes, json_objects, similarity

def now():
    return F.lit("2024-01-01").cast("timestamp_ntz")


def pages(spark, *rows):
    return spark.createDataFrame(rows, "id int, html string, url string")


def fields(spark, html, url="http://portal.example/x"):
    return advisories.advisories(pages(spark, (1, html, url)), now()).first()


def test_the_first_form_with_a_value_wins(spark):
    html = """<dl><dt>Vendor</dt><dd> </dd><dt>Éditeur :</dt><dd>From list</dd></dl><table><tr><th>Vendor</th><td>From table</td></tr></table><p>Vendor: from text</p>"""
    assert fields(spark, html).vendor == "From list"  # éditeur comes before vendor among the labels
    assert fields(spark, html.replace("Éditeur", "Other")).vendor == "From table"
    assert fields(spark, "<p><strong>Vendor :</strong> In <i>text</i><br>next</p>").vendor == "In text"
    assert fields(spark, "<p>Vendor: plain<br>next</p>").vendor == "plain" and fields(spark, "<p>none</p>").vendor is None


def test_lines_belong_to_the_label_above_them(spark):
    html = "<title>Flaw | Portal</title><p></p><h2>Impact :</h2><p>one</p><p>two</p><h2>IMPACT</h2><p>again</p><h2>Systèmes affectés</h2><ul><li>A 1.0</li><li>B 2.0</li></ul><h2>Accueil</h2><p>lost</p><h2>Références</h2><p>see http://a.example/x and http://b.example/y</p>tunCERT / Vuln.2026-12"
    found = fields(spark, html)
    assert (found.impact, found.affected_systems, found.affected_versions, found.title, found.product) == ("one ; two", ["A 1.0", "B 2.0"], "A 1.0 ; B 2.0", "Flaw", "Flaw")
    assert found.advisory_id == "tunCERT/Vuln.2026-12" and found.references == ["http://a.example/x", "http://b.example/y"]


def test_pages_that_say_nothing(spark):
    rows = advisories.advisories(pages(spark, (1, None, None), (2, "", "x"), (3, "<p>" * 3000, "http://a/b")).withColumn("a_page", F.lit(1)).withColumn("title", F.lit("own")), now()).collect()
    assert [(r.id, r.title, r.published_at, r.cves, r.references, r.affected_systems) for r in rows] == [(1, None, None, [], [], []), (2, None, None, [], [], []), (3, None, None, [], [], [])]


def near(spark, text):
    return {r.cve: r.published for r in identifier_dates.near_dates(spark.createDataFrame([(1, text)], "doc int, said string")).collect()}


def test_dates_on_both_sides_of_several_ids(spark):
    one, two, three = "CVE-2024-1001", "CVE-2024-1002", "CVE-2024-1003"
    assert near(spark, f"2024-01-01 {one} 2024-01-02 {two} published 2024-01-03") == {one: "2024-01-02", two: "2024-01-03"}
    # a date of publication farther away comes before a plain one, a deadline and a change never count
    assert near(spark, f"{one} 2024-01-02 then published on 2024-01-05 {two} due date 2024-02-01 last updated 2024-02-02") == {one: "2024-01-05", two: "2024-01-05"}
    assert near(spark, f"{one} {'x' * 1500} 2024-01-02") == {one: None}
    assert near(spark, f"2024-01-02 {'x ' * 80} {one}") == {one: None}
    assert near(spark, f"{one} and {one} 3 January 2024; {three.lower()}") == {one: "2024-01-03", three: "2024-01-03"}
    assert near(spark, "no id 2024-01-01") == {} and near(spark, "") == {}


def test_kinds_of_bodies_and_their_dates(spark):
    rows = [
        (1, '[{"ID": "CVE-2020-0001", "Created": "Jul 24, 2026", "updated": "25/07/2026"}, {"cve": "cve-2020-0001", "published": "2026-01-01"}, {"x": {"id": "CVE-2020-0002", "date": 5}}]', None, None),
        (2, '<rss><item>CVE-2020-0003 <pubDate>Fri, 24 Jul 2026 10:00</pubDate></item><entry><id>none</id></entry></rss>', "text/xml", None),
        (3, '{"no": "id"}', None, "api"), (4, None, None, None), (5, "<p>CVE-2020-0004 31/02/2020</p>", None, None), (6, "{broken CVE-2020-0005 2020-01-02", None, None), (7, "<rss>CVE-2020-0006 on 2020-01-03</rss>", None, "rss"),
    ]
    found = identifier_dates.identifier_dates(spark.createDataFrame(rows, "doc int, body string, content_type string, method string"))
    got = {(r.doc, r.cve): (r.published, r.modified, r.found) for r in found.collect()}
    assert got == {
        (1, "CVE-2020-0001"): ("2026-07-24", "2026-07-25", "api"), (1, "CVE-2020-0002"): (None, None, "api"), (2, "CVE-2020-0003"): ("2026-07-24", None, "rss"),
        (5, "CVE-2020-0004"): (None, None, "scraping"), (6, "CVE-2020-0005"): ("2020-01-02", None, "scraping"), (7, "CVE-2020-0006"): ("2020-01-03", None, "scraping"),
    }


def test_nodes_of_nested_json(spark):
    deep = "[" * 70 + "]" * 70
    rows = [(1, '{"b": [1, {"c": "x"}, "t"], "a": {"n": 1.5, "f": true, "z": null}}'), (2, "3"), (3, "{broken"), (4, None), (5, deep), (6, '{"s": "[[[{"}')]
    found = json_nodes.json_nodes(spark.createDataFrame(rows, "doc int, body string")).collect()
    got = {(r.doc, tuple(r.path)): (r.kind, r.keys, r.scalars, r.items) for r in found}
    assert got == {
        (1, ()): ("object", [], {}, None), (1, (0,)): ("object", ["a"], {"n": "1.5"}, None), (1, (1,)): ("array", ["b"], None, ["t"]), (1, (1, 1)): ("object", ["b", None], {"c": "x"}, None), (6, ()): ("object", [], {"s": "[[[{"}, None),
    }


def test_products_by_cpe_and_references_of_records(spark):
    body = '{"list": [{"id": "CVE-2020-0001", "conf": {"m": ["cpe:2.3:a:acme_inc:big_box:1"]}, "w": {"value": "CWE-79"}, "refs": ["http://b", {"url": "http://a"}, "x", "http://b"]}, {"id": "none"}], "other": [{"n": "CVE-2020-0009"}]}'
    row = json_objects.json_records(spark.createDataFrame([(1, body)], "doc int, body string")).collect()
    assert [(r.cve_id, r.product, r.vendor, r.refs, r.weakness, r.weaknesses) for r in row] == [("CVE-2020-0001", "big box", "acme inc", ["http://b", "http://a"], "CWE-79", ["CWE-79"])]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names_are_those_of_all_pairs(spark):
    draw = random.Random(5)
    some = lambda n, least, most: list({"".join(draw.choices("abc", k=draw.randint(least, most))) for _ in range(n)})
    names, targets = some(120, 1, 11), some(40, 2, 9)
    want = {}
    for a, b in itertools.product(names, targets):
        if len(b) >= 4 and a != b:
            d = edits(a, b)
            if d <= (1 if len(b) <= 6 else 2):
                want[a, b] = d
            elif b in a:
                want[a, b] = 0
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in [*xs, None, xs[0]]], f"{c} string")
    found = similarity.near_names(frame(names, "name"), frame(targets, "target"))
    assert {(r.name, r.target): r.distance for r in found.collect()} == want and len(want) > 50
    assert similarity.near_names(frame(names, "name").where("1 = 0"), frame(targets, "target")).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="at least 4"):
        similarity.near_names(frame(names, "name"), frame(targets, "target"), least=3)


def test_cpes_are_met_as_by_containment(spark):
    draw = random.Random(6)
    parts = ["cpe", "2.3", "a", "acme", "acm", "box", "box_two", "1", "*"]
    cpes = list({":".join(draw.choices(parts, k=draw.randint(1, 7))) for _ in range(80)})
    wants = list({c[i:j] for c in cpes[:30] for i, j in [sorted(draw.sample(range(len(c) + 1), 2))]} | {"a", ":", "zz", "cpe:2.3:a:acme:box"})
    found = catalogue.cpe_join(spark.createDataFrame([(c,) for c in [*cpes, None, ""]], "cpe string"), spark.createDataFrame([(w,) for w in [*wants, None, ""]], "want string"))
    assert {(r.cpe, r.want) for r in found.collect()} == {(c, w) for c in cpes for w in wants if w and w in c}


def products(spark, *rows):
    schema = "name string, vendor string, domain string, aliases array<string>, keywords array<string>, cpes array<string>, enabled boolean, position int"
    domains = spark.createDataFrame([("off", False), ("on", True), ("unset", None)], "name string, enabled boolean")
    return catalogue.compiled(spark.createDataFrame(rows, schema), domains)


def test_the_catalogue_tells_products_from_vendors(spark):
    known = products(
        spark, ("Server", "Acme", "on", ["acme"], None, ["CPE:2.3:a:acme:server"], None, 1), ("Docker", "Docker", "unset", None, ["docker"], None, True, 2), ("Gone", "x", "on", None, None, None, False, 3),
        ("Hidden", "x", "off", None, None, None, True, 4), (None, "x", "on", None, None, None, True, 5), ("Tool", None, None, None, None, [], True, 6),
    )
    got = {r.name: (r.broad, r.specific, r.vendor_only, r.strict, r.cpes) for r in known.collect()}
    assert got == {
        "Server": (["server", "acme server", "acme"], ["server", "acme server"], ["acme"], ["acme"], ["cpe:2.3:a:acme:server"]),
        "Docker": (["docker", "docker docker"], ["docker", "docker docker"], [], ["docker"], []), "Tool": (["tool"], ["tool"], [], ["tool"], []),
    }
    rows = [(1, ["cpe:2.3:a:acme:server_x:1"], "acme ; tool", "x"), (2, [], "acme ; other", "docker"), (3, None, None, "a docker-tool in use"), (4, None, "", "dockers"), (5, [], "observer ; docker", None), (5, [], "observer ; docker", None)]
    records = spark.createDataFrame(rows, "id int, cpes array<string>, structured string, free string")
    found = sorted((r.id, r["product"], r.grade) for r in catalogue.graded(records, known).collect())
    assert found == [(1, "Server", "confirmed"), (1, "Tool", "high_confidence"), (2, "Server", "rejected"), (3, "Docker", "possible"), (3, "Tool", "possible"), (5, "Docker", "high_confidence"), (5, "Docker", "high_confidence")]
    hits = sorted((r.id, r["product"], r.is_primary) for r in catalogue.matched(records, known).collect())
    assert hits == [(1, "Server", True), (1, "Tool", False), (2, "Server", True), (3, "Docker", True), (3, "Tool", False), (5, "Docker", True), (5, "Docker", True)]
    assert catalogue.graded(records.where("1 = 0"), known).count() == 0 and catalogue.graded(records, known.where("1 = 0")).count() == 0


def test_copied_values_are_told_by_other_brands(spark):
    schema = "cve_id string, vendor string, cve_status string, verified array<string>, affected_systems array<string>, impact string, solution string"
    rows = [(f"C{k}", "Oracle Corp", None, ["solution"] if k == 1 else None, ["Oracle OS"], " Flaw of Apache server ", "Update") for k in range(3)]
    rows += [("D1", "Apache", None, None, ["Oracle OS"], "Flaw of Apache server", None), ("E1", None, None, None, None, "Flaw of Apache server", None), ("F1", "Oracle", "rejected", None, None, "Flaw of Apache server", None), ("G1", "code injection", None, None, None, "Update", "")]
    found = audits.contaminated(spark.createDataFrame(rows, schema))
    assert sorted((r.cve_id, r.field) for r in found.collect()) == [("C0", "impact"), ("C1", "impact"), ("C2", "impact")]
    assert audits.contaminated(spark.createDataFrame(rows, schema), least=1).where("field = 'affected_systems'").count() == 1
    assert audits.contaminated(spark.createDataFrame([], schema)).count() == 0


def test_values_stand_whole_or_within_longer_ones(spark):
    pages = spark.createDataFrame([(1, "fixed in 2.4.1, see https://a.example/x?y"), (2, None), (3, "CVE-2020-0001")], "id int, page string")
    texts = spark.createDataFrame([(1, "s", "2.4 and https://a.example/x"), (1, "t", "2.5"), (2, "s", "CVE-2020-0001"), (3, "s", "cve-2020-0001"), (4, "s", "no values"), (5, "s", None), (6, "s", "1.0")], "id int, field string, said string")
    got = {(r.id, r.field): r.invented for r in grounding.ungrounded(texts, pages).collect()}
    assert got == {(1, "s"): [], (1, "t"): ["2.5"], (2, "s"): ["CVE-2020-0001"], (3, "s"): [], (4, "s"): [], (5, "s"): [], (6, "s"): ["1.0"]}


def test_slugs_of_vendors(spark):
    rows = [("Red Hat", None), ("Google Chrome", []), ("F5", ["Linux Mac OS Windows"]), (None, ["NVD - CVE-2020-0001", "Windows Firefox 3", None]), ("Node.js", ["a", "b", "c", "Chrome"]), (None, None), ("NVD", [""]), ("Acme Cloud Systems", None)]
    frame = spark.createDataFrame(rows, "vendor string, products array<string>")
    got = [r.s for r in frame.select(official.vendor_slugs(F.col("vendor"), F.col("products")).alias("s")).collect()]
    assert got == [["redhat", "red-hat"], ["googlechrome", "google-chrome", "google", "chrome"], [], ["firefox", "mozilla"], ["nodejs"], [], [], ["acmecloudsystems", "acme-cloud-systems", "acme"]]


def test_scores_of_references(spark):
    urls = ["https://acme.com/x", "https://my-acme.org/security/1", "https://acmeco.com/", "https://github.com/acme/x/releases", "https://github.com/other/acme", "https://jira.acme.com/browse/1", "https://nvd.nist.gov/vuln/1", "https://blog.example/acme", "no url", None]
    frame = spark.createDataFrame([(u, ["acme"]) for u in urls], "url string, slugs array<string>")
    assert [r.s for r in frame.select(official.reference_score(F.col("url"), F.col("slugs")).alias("s")).collect()] == [100, 106, 0, 96, 0, 80, 56, 0, 0, 0]
