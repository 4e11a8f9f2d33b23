"""What the health of sources asks of its state: places that a batch itself outdates never get there."""

import datetime as dt
from types import SimpleNamespace

import pytest

from advisorium.streaming import source_health


class Places(dict):
    calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


class Handle:
    def __init__(self):
        self.maps, self.timers, self.now = {}, set(), None
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.now, update=lambda value: setattr(self, "now", value))

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Places())


@pytest.mark.parametrize("held", [source_health.HELD, 7])
def test_outdated_places_are_not_written(monkeypatch, held):
    monkeypatch.setattr(source_health, "HELD", held)
    handle, health = Handle(), source_health.Health()
    health.init(handle)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    at = lambda n: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=n)
    rows = [("a", n, at(n), ("failed", "empty")[n % 2], "x" if n % 2 == 0 else None) for n in range(1, 100)]
    good = ("a", 100, at(100), "success", None)
    late = [("a", 101, at(101), "failed", "y"), ("a", 102, at(102), "empty", None), ("a", 103, at(103), "failed", "z")]

    def step(batch):
        found = list(health.handleInputRows(("a",), iter(batch), clock))
        return [(r.retry_count, r.empty_streak, r.status, r.last_error, r.step) for r in found]

    assert step([*rows, good, *late]) == [(1, 1, "failed", "z", 1)]
    assert set(handle.maps["failures"]) == {(1_704_067_200_000_000 + 103 * 60_000_000, 103)} and len(handle.maps["empties"]) == 1 and len(handle.timers) == 1
    if held > 100:
        assert sum(x.calls for x in handle.maps.values()) == 2
    assert step(late) == [(1, 1, "failed", "z", 2)]  # repeated results count once
    assert step([("a", 104, at(104), "success", None)]) == [(0, 0, "success", None, 3)] and not any(handle.maps.values()) and len(handle.timers) == 1
