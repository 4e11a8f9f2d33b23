"""Date, text, score and url functions on small hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from advisorium.functions import dates, scoring, text, urls

NOW = dt.datetime(2026, 7, 24, 12, 0)


def values(spark, column, rows, ddl="v string"):
    """The column over one row per value."""
    given = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return [r[0] for r in spark.createDataFrame(given, f"i int, {ddl}").coalesce(1).orderBy("i").select(column).collect()]


def test_parsed_times(spark):
    day = lambda y, m, d, *t: dt.datetime(y, m, d, *t)
    cases = {
        "2h ago": NOW - dt.timedelta(hours=2), "il y a 30 minutes": NOW - dt.timedelta(minutes=30), "hier": NOW - dt.timedelta(days=1), "just now": NOW, "updated 3 days ago": NOW - dt.timedelta(days=3), "2 semaines auparavant": NOW - dt.timedelta(weeks=2),
        "2026-01-13": day(2026, 1, 13), "2026-01-13T10:20:30Z": day(2026, 1, 13, 10, 20, 30), "2026-01-13T10:20:30+02:00": day(2026, 1, 13, 8, 20, 30), "2026-01-13 10:20": day(2026, 1, 13, 10, 20), "on 2026-01-13 at noon": day(2026, 1, 13),
        "Jan 13, 2026": day(2026, 1, 13), "January 13th 2026": day(2026, 1, 13), "13 Jan 2026": day(2026, 1, 13), "29 juillet 2026": day(2026, 7, 29), "1 fevrier 2026": day(2026, 2, 1), "3 août 2026": day(2026, 8, 3), "5 decembre 2025": day(2025, 12, 5),
        "01/13/2026": day(2026, 1, 13), "13/01/2026": day(2026, 1, 13), "02.03.2026": day(2026, 2, 3), "31 février 2026": None, "13 foo 2026": None, "": None, "nothing": None,
    }
    assert dict(zip(cases, values(spark, dates.parsed_time(F.col("v"), F.lit(NOW).cast("timestamp_ntz")), list(cases)), strict=True)) == cases
    assert values(spark, dates.parsed_time(F.col("v"), F.lit(NOW).cast("timestamp_ntz")), [None]) == [None]


def test_dates_in_context(spark):
    got = values(spark, dates.date_kind(F.col("v")), ["Published: ", "published; last updated ", "due date: ", "on ", "Last Updated, then published", "", "date d'échéance "])
    assert got == ["publish", "modified", "deadline", "plain", "publish", "plain", "deadline"]
    day = dt.date(2026, 7, 4)
    assert values(spark, dates.names_day(F.col("v"), day), ["2026-07-04", "04/07/2026", "4/7/2026", "le 4 juillet 2026", "July 4, 2026", "JULY 4 2026", "2026-07-05", None]) == [True] * 6 + [False] * 2
    got = values(spark, dates.content_kind(F.col("b"), F.col("t"), F.col("m")), [(' {"a":1}', "text/html", "html"), ("<?xml ?>", None, None), ("<html>", "application/rss+xml", None), ("<p>", "application/json", "api"), (None, None, "rss"), ("<FEED>", None, None)], "b string, t string, m string")
    assert got == ["json", "xml", "xml", "html", "xml", "xml"]


def test_cleaning(spark):
    long = "A flaw in the parser lets remote attackers run code on the server "
    cases = {
        f"<p>{long}</p>": long.strip(), "too short": None, long + "@media screen": None, long + "<script>x</script>": None, long + "Access Denied": None, long + "subscribe": None, (long * 3 + "subscribe"): long * 3 + "subscribe",
        long + "extension < 2.4.1 - done": long + "extension < 2.4.1 - done", long + "&lt;script&gt; &#60; &#8217;a &#x2019; &nbsp;z": long + "&lt;script&gt; &#60; ’a ’ z", long + "guest-session cookie": long + "guest-session cookie",
    }
    assert dict(zip(cases, values(spark, text.clean_description(F.col("v")), list(cases)), strict=True)) == cases
    assert values(spark, text.clean_product(F.col("v")), ["Server 2", "CVE-2025-24293 - Overview", "Latest CVEs", "x" * 161, "<b>Tool</b>", None]) == ["Server 2", None, None, None, "Tool", None]
    assert values(spark, text.clean_text(F.col("v")), ["Apply the update now", "short", "Services Support Back Support Support Home Support Library", "Update Windows Update service and Windows Update agent"]) == ["Apply the update now", None, None, "Update Windows Update service and Windows Update agent"]


def test_words_and_sentences(spark):
    assert values(spark, text.fold_accents(F.col("v")), ["éditeur Àçñ", "é", "straße", None]) == ["editeur Acn", "e", "straße", None]
    assert values(spark, text.is_stop_word(F.col("v"), ["avons", "nous", "est", "vulnerabilites"]), ["avons-nous", "Vulnérabilités", "log4j-core", "x-force", "2024"]) == [True, True, False, False, True]
    assert values(spark, text.looks_english(F.col("v")), ["The attacker could run code from remote", "La faille est dans le serveur et permet", "the", None]) == [True, False, False, False]
    a = "This sentence is long enough to be kept as one."
    assert values(spark, text.last_sentence(F.col("v")), [a + " And this is cut", a, "Short. then cut", "", None]) == [a, a, None, None, None]
    assert values(spark, text.french_list(F.split("v", ",")), ["a,b,c", "a,b", "a"]) == ["a, b et c", "a et b", "a"]
    assert values(spark, text.bullets(F.col("v")), ["One; two • High\nThree. Four."]) == [["One", "two", "Three", "Four"]]
    assert values(spark, text.risk_severity(F.col("v")), ["Critique", " élevé", "modere", "bas", "other"]) == ["critical", "high", "medium", "low", None]
    assert values(spark, text.advisory_ids(F.col("v")), ["ghsa-ab12-cd34-ef56 GHSA-AB12-CD34-EF56"]) == [["GHSA-AB12-CD34-EF56"]]
    assert values(spark, text.text_lines(F.col("v")), ["<div>a <b>b</b></div><p> </p>c<br/>d &amp; e"]) == [["a b", "c", "d & e"]]
    assert values(spark, text.json_object(F.col("v")), ['ok ```json\n{"a": {"b": 1}}\n``` done', "none", "{broken"]) == ['{"a": {"b": 1}}', None, None]


def test_scores(spark):
    got = values(spark, scoring.cvss_metrics(F.col("v")), ["CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:N", "CVSS:4.0/AV:L/AT:H/VC:H/VI:L/VA:N/AC:L", "nothing", None])
    assert got == [{"AV": "N", "AC": "L", "PR": "N", "UI": "N", "S": "C", "C": "H", "I": "H", "A": "N"}, {"AV": "L", "AC": "H", "C": "H", "I": "L", "A": "N"}, {}, None]
    got = values(spark, scoring.exploitation(F.col("s"), F.col("r")), [("active", []), (" ", ["https://x/Known-Exploited-Vulnerabilities"]), (None, ["https://exploit-db.com/1"]), (None, ["https://a/"]), (None, None)], "s string, r array<string>")
    assert got == ["kev", "kev", "poc", None, None]
    assert values(spark, scoring.worst_severity(F.col("v")), [["low", "HIGH", "?"], ["x"], []], "v array<string>") == ["high", None, None]
    assert values(spark, scoring.pass_ratio([F.col("a"), F.col("b")]), [(True, None), (True, False), (None, None)], "a boolean, b boolean") == [100, 50, 0]
    assert values(spark, scoring.change_label("Score", F.col("a"), F.col("b")), [("7.1", "9.8"), (None, "9.8"), ("x", None), ("a", "a")], "a string, b string") == ["Score : 7.1 → 9.8", "Score : 9.8 (ajouté)", "Score : x → non renseigné", None]
    assert values(spark, scoring.severity(F.col("v")), [0.0, 0.1], "v double") == [None, "low"]


@pytest.mark.parametrize(
    ("url", "wanted"),
    [("https://fonts.googleapis.com/css", True), ("https://www.reddit.com/r/netsec/", True), ("https://www.reddit.com/r/netsec/comments/1/", False), ("https://www.nist.gov", True), ("https://a.org/?id=1", False), ("https://a.org/tag/x", True), ("https://a.org/advisory/1", False), ("ftp://a.org/x", True), (None, True), ("https://notw3.org/x", False)],
)
def test_decorative_urls(spark, url, wanted):
    assert values(spark, urls.decorative(F.col("v")), [url]) == [wanted]


def test_urls(spark):
    assert values(spark, urls.organisation(F.col("v")), ["csa.gov.sg", "cert.ssi.gouv.fr", "nvd.nist.gov", "com"]) == ["csa", "ssi", "nist", "com"]
    assert values(spark, urls.cites_other_id(F.col("u"), F.col("c")), [("x/CVE-2024-1111", "CVE-2024-2222"), ("x/cve-2024-2222", "CVE-2024-2222"), ("x", "CVE-2024-2222"), ("x/CVE-2024-1111", None)], "u string, c string") == [True, False, False, False]
    assert values(spark, urls.pdf_links(F.col("v")), ['<a href="/a.pdf">x</a><a href=\'b.PDF?x\'>y</a><a href="c.html">']) == [["/a.pdf", "b.PDF?x"]]
    assert values(spark, urls.first_without(F.col("v"), ["nvd.nist.gov"]), [["x", "https://nvd.nist.gov/1", "https://vendor/a"], []], "v array<string>") == ["https://vendor/a", None]
    assert values(spark, urls.publication_key(F.col("u"), F.col("t")), [(" HTTPS://A/b// ", "t"), ("", "New -- Post!"), (None, None)], "u string, t string") == ["https://a/b", "new-post", ""]
