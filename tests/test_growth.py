"""What keeps queries whole and quick on larger tables: ids of any length, texts read once, small tables dealt over tasks."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from advisorium.functions import advisories, text, urls
from advisorium.operators import json_objects

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ids_of_many_digits_stay_whole(spark):
    rows = spark.createDataFrame([("x/cve-2024-12345670", "CVE-2024-1234567"), ("x/cve-2024-12345678", "CVE-2024-12345678")], "u string, c string").coalesce(1)
    assert [tuple(r) for r in rows.select(urls.cites_other_id(F.col("u"), F.col("c")), text.cve_ids(F.col("u"))).collect()] == [(True, ["CVE-2024-12345670"]), (False, ["CVE-2024-12345678"])]


def test_a_text_is_cleaned_once(spark):
    rows = spark.createDataFrame([("a", "b")], "v string, w string")
    for clean in (text.clean_description, text.clean_product, text.clean_text):
        assert plan_of(rows.select(clean(F.concat("v", "w")).alias("x"))).count("[a-zA-Z/!]") == 1
    assert plan_of(__spark_entry__.queries()["clean_descriptions"](spark, SF)).count("[a-zA-Z/!]") == 1


def test_json_is_read_in_one_pass(spark):
    rows = spark.createDataFrame([(1, '{"id": "CVE-2020-0001"}')], "doc int, body string")
    assert plan_of(json_objects.json_records(rows)).count("LogicalRDD") == 1


def test_records_of_a_list_of_references(spark):
    body = '{"references": [{"id": "CVE-2020-0001", "url": "http://own", "x": {"references": ["http://in"]}}, {"id": "CVE-2020-0002", "n": 1.50}, [{"id": "CVE-2020-0003"}]]}'
    found = json_objects.json_records(spark.createDataFrame([(1, body)], "doc int, body string"))
    assert sorted((r.at, r.cve_id, r.refs) for r in found.collect()) == [(0, "CVE-2020-0001", ["http://in"]), (1, "CVE-2020-0002", [])]


def test_labels_are_found_in_any_case(spark):
    pages = ["<b>TİTRE</b> one<br>", "<b>tıtre :</b> two</p>", "ſolution: three\n", "none"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").coalesce(1)
    labels = [*advisories.FIELD_LABELS["title"], *advisories.FIELD_LABELS["solution"]]
    low, page = advisories.folded(F.col("p")), F.col("p")
    free = F.coalesce(*[advisories.inline(page, x) for x in labels])
    got = rows.select("i", free.alias("a"), advisories.labelled(page, low, advisories.pairs(page), labels).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [r.a for r in got] and got[2].b == "three" and got[3].b is None


@pytest.mark.parametrize("name", ["json_records", "linked_dates", "advisory_pages", "official_sources", "audit_after_repair"])
def test_small_tables_are_dealt_over_tasks(spark, name):
    assert "RepartitionByExpression" in plan_of(__spark_entry__.queries()[name](spark, SF))
