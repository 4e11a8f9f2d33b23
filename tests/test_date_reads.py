"""Dates of identifiers: bodies are read as seldom as can be, and null, repeated and empty bodies give what they gave before."""

import itertools

import pytest

from advisorium.operators import identifier_dates, json_nodes

SCHEMA = "doc int, body string, content_type string, method string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def found(spark, *bodies):
    rows = identifier_dates.identifier_dates(spark.createDataFrame([(doc, body, None, None) for doc, body in bodies], SCHEMA)).collect()
    return sorted(((r.doc, r.cve, r.published, r.modified, r.found) for r in rows), key=str)


def test_ids_and_dates_meet_without_a_join(spark):
    near = identifier_dates.near_dates(spark.createDataFrame([(1, "CVE-2020-0001 2020-01-02")], "doc int, said string"))
    assert "Join" not in plan_of(near) and plan_of(near).count("LogicalRDD") == 1
    assert near._jdf.queryExecution().sparkPlan().toString().count("Window") == plan_of(near).count("Window")
    whole = plan_of(identifier_dates.identifier_dates(spark.createDataFrame([(1, "{}", None, None)], SCHEMA)))
    assert whole.count("LogicalRDD") == 8


def test_depths_are_told_in_one_reading(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(json_nodes, "levels_of", lambda *a, **b: pytest.fail("bodies are read once more"))
    monkeypatch.setattr(identifier_dates, "levels_of", lambda *a, f=identifier_dates.levels_of, **b: asked.append(f(*a, **b)) or asked[-1])
    block = '<script type="application/ld+json">{"@graph": [{"name": "CVE-2020-0002", "datePublished": "2020-01-02"}]}</script>'
    assert found(spark, (1, '{"a": [[{"id": "CVE-2020-0001", "date": "2020-01-01"}]]}'), (2, block)) == [(1, "CVE-2020-0001", "2020-01-01", None, "api"), (2, "CVE-2020-0002", "2020-01-02", None, "json_ld")]
    assert asked == [{"json": 4, "block": 3}]


def test_depths_by_kind(spark):
    rows = spark.createDataFrame([("a", "[[1]]"), ("a", "[" * 70 + "]" * 70), ("b", "1"), ("c", None), (None, "{}")], "kind string, body string")
    assert json_nodes.levels_of(rows, by="kind") == {"a": 2, "b": 0, None: 1}
    assert json_nodes.levels_of(rows) == 2 and json_nodes.levels_of(rows.where("1 = 0")) == 0 and json_nodes.levels_of(rows.where("1 = 0"), by="kind") == {}


def test_null_repeated_and_empty_bodies(spark):
    page, text = "<p>CVE-2020-0001 published 2020-01-02</p>", '{"id": "CVE-2020-0002", "date": "2020-02-03"}'
    assert found(spark) == []
    assert found(spark, (1, None), (2, ""), (3, "{}"), (4, "<rss></rss>")) == []
    assert found(spark, (None, page)) == [(None, "CVE-2020-0001", None, None, "scraping")]  # without a doc no day meets its id
    assert found(spark, (None, text)) == [(None, "CVE-2020-0002", "2020-02-03", None, "api"), (None, "CVE-2020-0002", None, None, "scraping")]
    assert found(spark, (1, page), (1, page)) == [(1, "CVE-2020-0001", "2020-01-02", None, "scraping")]
    assert found(spark, (1, text), (1, text)) == [(1, "CVE-2020-0002", "2020-02-03", None, "api")]


def test_days_of_ids_as_by_all_pairs(spark):
    """Against every pair of an id and a day between it and its neighbours."""
    gaps, days = ["x " * 3, "y" * 150 + " ", "z " * 720], ["2020-01-02", "published 2020-01-03", "due date 2020-01-04", "31/02/2020"]
    texts = [a + "CVE-2020-0001" + b + x + c + "CVE-2020-0002" + d + y for a, b, c, d in itertools.product(gaps[:2], gaps, gaps, gaps[:1]) for x, y in itertools.product(days, days[:2])]
    got = {(r.doc, r.cve): r.published for r in identifier_dates.near_dates(spark.createDataFrame([*enumerate(texts)], "doc int, said string")).collect()}
    want = {}
    for doc, t in enumerate(texts):
        ids = [t.index("CVE-2020-0001"), t.index("CVE-2020-0002")]
        said = sorted((t.index(d[-10:], at), d) for at, d in ((ids[0] + 13, next(x for x in days if x in t[ids[0] : ids[1]])), (ids[1] + 13, next(x for x in days if t.endswith(x)))))
        for k, cve in enumerate(("CVE-2020-0001", "CVE-2020-0002")):
            fit = []
            for at, d in said:
                rank = 0 if d.startswith("published") else 1
                nearest = max([i for i in ids if i < at], default=None)
                following = min([i for i in ids if i > at], default=None)
                if d[0] == "d" or d.startswith("31"):
                    continue
                if nearest == ids[k] and at < ids[k] + 1400:
                    fit.append((rank, at - ids[k], d[-10:]))
                if following == ids[k] and at >= ids[k] - 120:
                    fit.append((rank + 2, ids[k] - at, d[-10:]))
            want[doc, cve] = min(fit)[2] if fit else None
    assert got == want
