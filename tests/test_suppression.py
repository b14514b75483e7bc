"""Repeated requests in streams: 24 hours from the request that was asked, whatever the batches."""

import json
import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from auditlake.streaming import incremental, suppression

START = datetime(2024, 1, 1)


def deliver(folder, number, rows):
    folder.mkdir(exist_ok=True)
    file = folder / f"{number:04d}.json"
    file.write_text("".join(json.dumps({"request_id": k, "ts": t.isoformat() if t else None, "note": "x"}) + "\n" for k, t in rows))
    os.utime(file, (1_700_000_000 + number,) * 2)  # files are read in the order of their times


def call(spark, tmp_path, late, files_per_batch=1000):
    stream = incremental.arriving(spark, str(tmp_path / "in"), "request_id string, ts timestamp, note string", "json", maxFilesPerTrigger=files_per_batch)
    asked, late_rows = suppression.run(stream, str(tmp_path / "base"), late=late)
    return sorted((r.request_id, r.asked_at) for r in asked.collect()), sorted((r.request_id, r.ts, r.note) for r in late_rows.collect())


def chain(rows, until):
    out = []
    for key in {k for k, t in rows if k and t}:
        last = None
        for t in sorted(t for k, t in rows if k == key and t and t <= until):
            if last is None or t - last >= timedelta(hours=24):
                out.append((key, t))
                last = t
    return sorted(out)


def test_midnight_is_no_border_and_late_rows_are_kept(spark, tmp_path):
    src = tmp_path / "in"
    deliver(src, 0, [("a", datetime(2024, 1, 1, 23, 59)), ("b", datetime(2024, 1, 1, 10)), (None, START), ("a", None)])
    first, late = call(spark, tmp_path, "0 seconds")
    assert first == [("a", datetime(2024, 1, 1, 23, 59)), ("b", datetime(2024, 1, 1, 10))] and late == []
    deliver(src, 1, [("a", datetime(2024, 1, 2, 0, 1)), ("a", datetime(2024, 1, 2, 23, 59)), ("b", datetime(2024, 1, 1, 9)), ("c", datetime(2024, 1, 5))])
    second, late = call(spark, tmp_path, "0 seconds")
    assert second == [("a", datetime(2024, 1, 1, 23, 59)), ("a", datetime(2024, 1, 2, 23, 59)), ("b", datetime(2024, 1, 1, 10)), ("c", datetime(2024, 1, 5))]
    assert late == [("b", datetime(2024, 1, 1, 9), "x")]
    assert call(spark, tmp_path, "0 seconds") == (second, late)  # nothing new arrived


@pytest.mark.parametrize("files_per_batch", [2, 1000])
def test_the_split_into_batches_changes_nothing(spark, tmp_path, files_per_batch):
    random.seed(9)
    rows = [(random.choice("aab") + str(random.randint(0, 2)), START + timedelta(minutes=random.randint(0, 9 * 1440), microseconds=random.randint(0, 9))) for _ in range(400)]
    rows += rows[:40]
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(minutes=random.randint(0, 600)))
    for n in range(6):
        deliver(tmp_path / "in", n, arrival[n * 74 : (n + 1) * 74])
    asked, late = call(spark, tmp_path, "11 hours", files_per_batch)
    newest = max(t for _, t in rows)
    assert late == [] and asked == chain(rows, newest.replace(microsecond=0) - timedelta(hours=11))


@pytest.mark.parametrize("times", [20, 1000])
def test_a_key_costs_a_few_calls_of_the_state(times):
    calls = []

    class Held:
        def __init__(self):
            self.held = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("update", "put", "appendList"):
                    self.held = [*(self.held or []), *args[0]] if name == "appendList" else args[0]
                elif name == "clear":
                    self.held = None
                return iter(self.held) if name == "get" and isinstance(self.held, list) else self.held

            return call

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Held()

        getListState = getMapState = getValueState  # noqa: N815

        def registerTimer(self, ms):  # noqa: N802
            calls.append("registerTimer")

        deleteTimer = registerTimer  # noqa: N815

    hour = 3_600_000_000
    watermark = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 30 * 3_600_000})()
    ask = suppression.AskOnce(24)
    ask.init(Handle())
    rows = pd.DataFrame({"at": [n * 40 * hour // times for n in range(times)]})
    ask.handleInputRows(("a",), iter([rows, rows]), watermark)
    (asked,) = ask.handleExpiredTimer(("a",), watermark, None)
    assert asked["at"].tolist() == [0, 24 * hour] and len(calls) <= 12


class Kept:
    """State in memory: a value or a list, with the number of calls."""

    def __init__(self):
        self.calls, self.states, self.bells = 0, {}, set()

    def getValueState(self, name, _):  # noqa: N802
        kept = self

        class State:
            def __getattr__(self, call):
                def called(*args):
                    kept.calls += 1
                    if call == "get":
                        return iter(kept.states[name]) if isinstance(kept.states.get(name), list) else kept.states.get(name)
                    kept.states[name] = {"clear": None, "appendList": [*(kept.states.get(name) or []), *args[0]] if args else None}.get(call, args[0] if args else None)

                return called

        return State()

    getListState = getMapState = getValueState  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.bells.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.bells.remove(ms)


@pytest.mark.parametrize("packed", [7, 50_000])
def test_many_keys_of_a_group_cost_a_few_calls_and_are_forgotten(monkeypatch, packed):
    monkeypatch.setattr(suppression, "PACKED_ROWS", packed, raising=False)
    rnd, hour, kept, got = random.Random(4), 3_600_000_000, Kept(), []
    ask = suppression.AskOnce(24)
    ask.init(kept)
    rows = [(f"k{rnd.randint(0, 300)}", rnd.randint(0, 20 * 24 * hour)) for _ in range(5000)]
    rows += rows[:500]
    for day in range(21):  # what comes in a day is from there on to eight hours later, then the watermark follows
        part = pd.DataFrame([r for r in rows if day * 24 * hour < r[1] + r[1] % 8 * hour <= (day + 1) * 24 * hour], columns=["key", "at"])
        before = kept.calls
        ask.handleInputRows((0,), iter([part[:40], part[40:]]), None)
        now = ((day + 1) * 24 - 8) * 3_600_000
        if any(bell <= now for bell in kept.bells):
            kept.bells -= {bell for bell in kept.bells if bell <= now}
            (asked,) = ask.handleExpiredTimer((0,), type("Times", (), {"getCurrentWatermarkInMs": lambda self: now})(), None)  # noqa: B023
            got += asked.itertuples(index=False, name=None)
        assert packed == 7 or kept.calls - before <= 13
    at = START + timedelta(days=100)
    assert sorted((k, START + timedelta(microseconds=t)) for k, t in got) == chain([(k, START + timedelta(microseconds=t)) for k, t in rows], at)
    (bell,) = kept.bells
    (asked,) = ask.handleExpiredTimer((0,), type("Times", (), {"getCurrentWatermarkInMs": lambda self: bell})(), None)
    assert not len(asked) and not any(kept.states.values())


def test_keys_that_share_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suppression, "BUCKETS", 2)
    rnd = random.Random(8)
    rows = [(f"k{rnd.randint(0, 40)}", START + timedelta(minutes=rnd.randint(0, 9 * 1440))) for _ in range(900)]
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rnd.randint(0, 600)))
    for n in range(3):
        deliver(tmp_path / "in", n, arrival[n * 300 : (n + 1) * 300])
        asked, late = call(spark, tmp_path, "11 hours")
    assert late == [] and asked == chain(rows, max(t for _, t in rows) - timedelta(hours=11))
