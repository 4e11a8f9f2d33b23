"""Streamed state over several files in any order: health of sources with timers, and stores in buckets."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from advisorium.streaming import runs, source_health
from advisorium.streaming.store import KeyedStore

RESULT = "source string, id long, ts timestamp, status string, error string"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


RESULTS = [
    ("a", 1, at(0), "success", None), ("a", 2, at(1), "empty", None), ("a", 3, at(2), "failed", "x"), ("a", 4, at(3), "empty", None), ("a", 5, at(4), "timeout", "timeout"), ("a", 6, at(5), "failed", "y"), ("a", 7, at(6), "failed", "z"),
    ("b", 10, at(0), "failed", "x"), ("b", 11, at(1), "parse_error", "parse_error"),
    ("c", 20, at(1), "success", None), *[("c", 21 + k, at(2 + k), "empty", None) for k in range(6)],
    ("d", 40, at(50), "success", None), ("d", 41, at(51), "failed", "q"), (None, 50, at(1), "failed", "x"),
]
WANT = {
    "a": ("failed", 3, 2, at(6), at(3), "z", ["retries", "stale"]), "b": ("parse_error", 2, 0, at(1), None, "parse_error", ["stale"]),
    "c": ("empty", 0, 6, at(7), at(7), None, ["empty", "stale"]), "d": ("failed", 1, 0, at(51), at(50), "q", []),
}


def fed(spark, tmp_path, name, batches):
    """The feed after files of rows, read one by one in the order given."""
    for rows in batches:
        spark.createDataFrame(rows, RESULT).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        os.sync()
    return runs.drained(spark, str(tmp_path / name), source_health.source_health, "update", str(tmp_path / f"{name}-state"), files=1)


def test_health_is_the_same_for_any_order_of_results(spark, tmp_path):
    orders = [RESULTS, RESULTS[::-1], random.Random(3).sample(RESULTS, len(RESULTS)) + RESULTS[:9]]  # the last repeats some
    for k, rows in enumerate(orders):
        feed = fed(spark, tmp_path, f"in{k}", [rows[i::3] for i in range(3)])
        got = {r.source: (r.status, r.retry_count, r.empty_streak, r.last_attempt, r.last_good, r.last_error, r.alerts) for r in source_health.last_states(feed).collect()}
        assert got == WANT, k


def test_a_timer_opens_an_alert_without_input_and_a_good_result_closes_it(spark, tmp_path):
    first = [("a", 1, at(0), "success", None), ("z", 2, at(30), "success", None)]
    feed = fed(spark, tmp_path, "in", [first])
    turns = {r.source: (r.opened, r.step) for r in feed.where(F.size("opened") > 0).collect()}
    assert turns == {"a": (["stale"], 2)}  # after its first step, when only z moved the clock
    again = fed(spark, tmp_path, "more", [first, [("z", 4, at(30.5), "empty", None)], [("a", 3, at(31), "empty", None)]])
    closed = again.where(F.size("closed") > 0).collect()
    assert [(r.source, r.closed) for r in closed] == [("a", ["stale"])]
    assert {r.source: r.alerts for r in source_health.last_states(again).collect()} == {"a": [], "z": []}


def test_delay_alert(spark):
    rows = spark.createDataFrame([(at(1), at(1.1)), (at(2), at(2.5)), (None, at(9)), (at(0), at(5))], "due timestamp, ts timestamp")
    assert tuple(source_health.delay_alerts(rows).first()) == ("scheduler:delay", "warning", 30, True)


def written(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_batch_rewrites_only_its_buckets_and_counts_once(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, at int, v string").schema
    store = KeyedStore(spark, str(tmp_path / "store"), schema, "k", buckets=8)
    assert store.read().count() == store.changes().count() == store.log().count() == 0
    rows = spark.createDataFrame([(k, 1, f"v{k}") for k in range(40)] + [(1, 0, "old"), (None, 1, "none")], schema)
    log = spark.createDataFrame([("info", "s", "first")], "level string, source string, message string")
    assert store.apply(rows, 0, log)
    before, kept = written(tmp_path / "store"), store.manifest()
    assert not store.apply(rows, 0, log) and written(tmp_path / "store") == before and store.log().count() == 1
    assert store.apply(spark.createDataFrame([(1, 2, "new"), (2, 0, "late"), (99, 1, None)], schema), 1, log)
    after = store.manifest()
    touched = {b for b, n in after[1].items() if n == 1}
    assert 0 < len(touched) <= 3 and all(after[1][b] == n for b, n in kept[1].items() if b not in touched)
    assert before.items() <= written(tmp_path / "store").items()  # no file of the first batch was touched
    got = {r.k: (r.at, r.v) for r in store.read().collect()}
    assert got == {k: (1, f"v{k}") for k in range(40)} | {1: (2, "new"), 99: (1, None)}
    changes = [(r.k, r.before.v if r.before else None, r.after.v) for r in store.changes().where("batch = 1").collect()]
    assert sorted(changes) == [(1, "v1", "new"), (99, None, None)] and store.log().count() == 2
    assert store.apply(spark.createDataFrame([], schema), 2) and store.read().count() == 41


def test_a_batch_without_its_manifest_is_written_over(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    store = KeyedStore(spark, str(tmp_path / "store"), schema, "k", buckets=2)
    store.apply(spark.createDataFrame([(1, "a"), (2, "b")], schema), 0)
    store.apply(spark.createDataFrame([(1, "z"), (3, "c")], schema), 1)
    for f in (tmp_path / "store" / "manifest" / f"{1:012d}").iterdir():
        f.unlink()  # as if the batch had failed at its end
    assert {r.k: r.v for r in store.read().collect()} == {1: "a", 2: "b"} and store.changes().count() == 2
    assert store.apply(spark.createDataFrame([(1, "y")], schema), 1)
    assert {r.k: r.v for r in store.read().collect()} == {1: "y", 2: "b"}


def test_each_key_once_for_any_order_of_files(spark, tmp_path):
    rows = [(k, at(24 * (k % 9))) for k in range(60)]
    for n, files in enumerate(([rows[:20], rows[20:40], rows[40:]], [rows[40:] + rows[:5], rows[20:40], rows[:20]])):
        for part in files:
            spark.createDataFrame(part, "k long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
        store = runs.deduplicated(spark, str(tmp_path / f"in{n}"), "k", "ts", str(tmp_path / f"state{n}"), files=1)
        assert sorted((r.k, r.ts) for r in store.read().collect()) == rows
        assert store.changes().select("batch").distinct().count() == 3
