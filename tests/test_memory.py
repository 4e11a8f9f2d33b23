"""Joins and groups whose memory in one task must not follow the table: dealt over tasks, not broadcast or read by one task."""

import __spark_entry__
from advisorium.sources import tables

SF = "/root/testdata/sf0.001"


def check_dealt(spark, name):
    run = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution()
    assert "RepartitionByExpression" in run.optimizedPlan().toString()
    assert "Broadcast" not in run.executedPlan().toString()


def test_drafts_and_pages_are_dealt(spark):
    check_dealt(spark, "grounded_drafts")


def test_texts_and_pages_are_dealt(spark):
    check_dealt(spark, "invented_values")
    plan = __spark_entry__.queries()["invented_values"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == plan.count("Relation [c_custkey")


def test_pairs_of_ids_and_values_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 700)
    assert tables.tasks_for(spark, SF, "region") == 4  # the session's
    tasks = tables.tasks_for(spark, SF, "lineitem")
    assert tasks > 4
    found = __spark_entry__.queries()["contamination_groups"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [f"RepartitionByExpression [{x}" in plan for x in ("cve_id", "l_orderkey", "o_orderkey")] == [True] * 3 and plan.count(f"], {tasks}") == 3
    rows = [tuple(r) for r in found.collect()]
    monkeypatch.undo()
    assert sorted(rows) == sorted(tuple(r) for r in __spark_entry__.queries()["contamination_groups"](spark, SF).collect())
