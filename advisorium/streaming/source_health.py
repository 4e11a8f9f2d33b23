"""Each source's state and alerts, kept over a stream of collection results by state with timers.

What counts is told by a result's own time and id, never by the order of arrival: a retry count is the number of
failures after the last good result, an empty streak that of empty results after the last one that found
something. So late and repeated results give what they would have given in time, and no result is dropped. State
holds only results that can still count. A timer tells, without any input, that a source has gone stale.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

#: Hours without a good result, failures, empty results and minutes of delay from which an alert is raised (fixed values).
STALE_HOURS, RETRIES, EMPTIES, DELAY_MINUTES = 24, 3, 5, 15
#: How far the watermark is held back, so that no late result is dropped; timers are set back as far, so they follow the newest time.
LATE_DAYS = 3650
#: Places of results that a batch holds of one source before it writes those that still count to the state.
HELD = 10_000
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
#: Alerts and their levels (fixed values).
LEVELS = {"stale": "critical", "retries": "warning", "empty": "info", "delay": "warning"}

FEED = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("status", T.StringType()), T.StructField("retry_count", T.LongType()), T.StructField("empty_streak", T.LongType()),
    T.StructField("last_attempt", T.TimestampType()), T.StructField("last_good", T.TimestampType()), T.StructField("last_error", T.StringType()),
    T.StructField("opened", T.ArrayType(T.StringType())), T.StructField("closed", T.ArrayType(T.StringType())), T.StructField("step", T.LongType()),
])


def result_status(detected: Column, error: Column) -> Column:
    """success, empty, failed, timeout or parse_error: by the error's text, and only else by whether anything was detected."""
    bad = F.when(error.isin("timeout", "parse_error"), error).when(F.length(error) > 0, F.lit("failed"))
    return F.coalesce(bad, F.when(detected > 0, "success").otherwise("empty"))


def _micros(at: dt.datetime) -> int:
    since = (at if at.tzinfo else at.replace(tzinfo=dt.UTC)) - EPOCH
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


class Health(StatefulProcessor):
    """One source: its newest result, its last good one, and the failures and empty results that came after.

    A call of the state costs far more than a result, so what a batch itself outdates never gets there: places are held in
    memory, up to HELD of them, and those that still count at the end are written. All else of a source is one value.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = ["newest_ts", "newest_id", "good_ts", "good_id", "found_ts", "found_id", "retries", "empties", "due", "step"]
        fields = [(x, T.LongType()) for x in longs] + [(x, T.StringType()) for x in ("status", "error")] + [(x, T.BooleanType()) for x in ("on_stale", "on_retries", "on_empty")]
        self.value = handle.getValueState("source", T.StructType([T.StructField(x, t) for x, t in fields]))
        place = T.StructType([T.StructField("ts", T.LongType()), T.StructField("id", T.LongType())])
        self.failures = handle.getMapState("failures", place, T.StructType([T.StructField("one", T.LongType())]))
        self.empties = handle.getMapState("empties", place, T.StructType([T.StructField("one", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.value.get() or ((None,) * 6 + (0, 0, None, 0, None, None, False, False, False))
        newest, good, found = ((old[i], old[i + 1]) if old[i] is not None else None for i in (0, 2, 4))
        retries, empties, due, step, status, error = old[6:12]
        failed, empty, good_then, found_then = set(), set(), good, found
        for _, number, ts, said, why in rows:
            place = (_micros(ts), number)
            if newest is None or place > newest:
                newest, status, error = place, said, why
            if said == "success":
                found, good = max(found or place, place), max(good or place, place)
            elif said == "empty":
                good = max(good or place, place)
                if found is None or place > found:
                    empty.add(place)
            elif good is None or place > good:
                failed.add(place)
            if len(failed) + len(empty) >= HELD:
                retries = self.settled(self.failures, retries, failed, good, good_then)
                empties = self.settled(self.empties, empties, empty, found, found_then)
                failed, empty, good_then, found_then = set(), set(), good, found
        retries = self.settled(self.failures, retries, failed, good, good_then)
        empties = self.settled(self.empties, empties, empty, found, found_then)
        error = error if status in ("failed", "timeout", "parse_error") else None
        now = None if good is None else good[0] // 1000 + STALE_HOURS * 3_600_000 + 1 - LATE_DAYS * 86_400_000
        stale = now is None or now <= timerValues.getCurrentWatermarkInMs()
        now = None if stale else now
        if now != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if now is not None:
                self.handle.registerTimer(now)
        none = (None, None)
        yield self.told(key, (*(newest or none), *(good or none), *(found or none), retries, empties, now, step + 1, status, error), stale, old[12:])

    @staticmethod
    def settled(places: MapState, kept: int, fresh: set[tuple[int, int]], bound: tuple[int, int] | None, before: tuple[int, int] | None) -> int:
        """How many places the state holds once it has the fresh ones after bound, and no longer any up to it; it held kept after before."""
        if kept and bound != before:
            held = [tuple(k) for k in places.keys()]
            gone = [k for k in held if k <= bound]
            kept = len(held) - len(gone)
            if not kept:
                places.clear()
            for k in gone if kept else []:
                places.removeKey(k)
        known = kept > 0
        for place in fresh:
            if (bound is None or place > bound) and not (known and places.containsKey(place)):
                places.updateValue(place, (1,))
                kept += 1
        return kept

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        old = self.value.get()
        yield self.told(key, (*old[:8], None, old[9] + 1, *old[10:12]), True, old[12:])

    def told(self, key: Any, value: tuple, stale: bool, before: tuple) -> Row:
        """The state as it is now, which is kept, with the alerts that open and close."""
        retries, empties = value[6:8]
        now = {"stale": stale, "retries": retries >= RETRIES, "empty": empties >= EMPTIES}
        was = dict(zip(now, before, strict=True))
        self.value.update((*value, *now.values()))
        at = lambda micros: None if micros is None else EPOCH + dt.timedelta(microseconds=micros)
        return Row(
            source=key[0], status=value[10], retry_count=retries, empty_streak=empties, last_attempt=at(value[0]), last_good=at(value[2]), last_error=value[11],
            opened=[x for x in now if now[x] and not was[x]], closed=[x for x in now if was[x] and not now[x]], step=value[9],
        )

    def close(self) -> None:
        pass


def source_health(results: DataFrame) -> DataFrame:
    """A feed of states and alerts, a row for each source and batch that changed it or let its timer run out.

    results is a stream of source (string), id (long), ts (timestamp), status and error. The clock is the newest
    time in the stream. Results without a source, id or time are left out, and those of over LATE_DAYS before the newest one.
    """
    spark = results.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = results.where("source is not null and id is not null and ts is not null").select("source", "id", "ts", "status", "error").withWatermark("ts", f"{LATE_DAYS} days")
    return told.groupBy("source").transformWithState(Health(), FEED, "Update", "EventTime")


def last_states(feed: DataFrame) -> DataFrame:
    """Each source's newest row of a feed, with the alerts that are open: stale, retries, empty."""
    columns = [x for x in FEED.names if x not in ("opened", "closed", "step")]
    newest = feed.groupBy("source").agg(F.max_by(F.struct(*columns[1:]), "step").alias("now"))
    turned = feed.select("source", "step", F.explode(F.concat(F.transform("opened", lambda x: F.struct(x.alias("alert"), F.lit(True).alias("on"))), F.transform("closed", lambda x: F.struct(x.alias("alert"), F.lit(False).alias("on"))))).alias("turn"))
    active = turned.groupBy("source", "turn.alert").agg(F.max_by("turn.on", "step").alias("on")).where("on").groupBy("source").agg(F.array_sort(F.collect_list("alert")).alias("alerts"))
    return newest.join(active, "source", "left").select("source", "now.*", F.coalesce("alerts", F.array().cast("array<string>")).alias("alerts"))


def delay_alerts(runs: DataFrame) -> DataFrame:
    """A planned run's alert: alert_key, level, delay_minutes, active, from the newest run by its due time (due, ts)."""
    minutes = F.floor(F.timestamp_diff("SECOND", F.col("due"), F.col("ts")) / 60)
    newest = runs.where("due is not null and ts is not null").agg(F.max_by(minutes, F.struct("due", "ts")).alias("delay_minutes"), F.max_by(F.timestamp_diff("SECOND", F.col("due"), F.col("ts")), F.struct("due", "ts")).alias("seconds"))
    return newest.select(F.lit("scheduler:delay").alias("alert_key"), F.lit(LEVELS["delay"]).alias("level"), "delay_minutes", (F.col("seconds") > DELAY_MINUTES * 60).alias("active"))
