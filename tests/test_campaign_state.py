"""The campaign state of a stream in several runs against a plain fold and the batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from auspex.streaming import campaigns

EVENTS = "wave string, event_id long, ts timestamp, kind string, packages long"
START = datetime(2024, 3, 1, tzinfo=timezone.utc)
KINDS = [*campaigns.COUNTED, *campaigns.COUNTED, *campaigns.STATUS, "note", None]


def at(minutes):
    return START + timedelta(minutes=minutes)


def some_events(seed, n=700, waves=("a", "b", None)):
    """Most events are of wave ``a``; many share a time."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        kind = rng.choice(KINDS)
        out.append((waves[0] if rng.random() < 0.6 else rng.choice(waves), k, at(rng.randrange(900)), kind, rng.choice([None, 500, 900]) if kind == "wave_started" else None))
    return out


def plain(events):
    """Counters, status, plan and last events of each wave, one event at a time in order."""
    waves = {}
    for wave, number, ts, kind, packages in sorted((e for e in events if e[1] is not None and e[2] is not None), key=lambda e: (e[2], e[1])):
        w = waves.setdefault(wave, {"n": 0, "status": "pending", "total": 0, "start": None, "recent": []} | dict.fromkeys(campaigns.COUNTED.values(), 0))
        w["n"] += 1
        w["end"] = ts
        w["recent"] = [str(number), *w["recent"]][: campaigns.RECENT]
        if kind in campaigns.COUNTED:
            w[campaigns.COUNTED[kind]] += 1
        w["status"] = campaigns.STATUS.get(kind, w["status"])
        if kind == "wave_started":
            w["start"] = w["start"] or ts
            w["total"] = w["total"] if packages is None else packages
    out = {}
    for wave, w in waves.items():
        seconds = (w["end"] - w["start"]).total_seconds() // 1 if w["start"] else 0
        left = max(w["total"] - w["scanned"], 0)
        rate = round(w["scanned"] / (seconds / 60), 6) if seconds > 0 else None
        eta = int(seconds / w["scanned"] * left) if seconds > 0 and w["scanned"] and left else None
        progress = round(w["scanned"] / w["total"] * 100, 6) if w["total"] else 0.0
        out[wave] = (w["status"], w["total"], w["n"], w["scanned"], w["flagged"], w["malicious"], w["failed"], progress, rate, eta, ",".join(w["recent"]))
    return out


def told(df):
    names = ["status", "packages_total", *campaigns.NAMES, "progress", "rate_per_minute", "eta_seconds", "recent_ids"]
    rows = df.collect()
    out = {r["wave"]: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


class Run:
    """A folder of events that a stream reads in several runs, each with a query of its own."""

    def __init__(self, spark, home, **options):
        self.spark, self.home, self.options = spark, home, options

    def __call__(self, events, once=False):
        self.spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(str(self.home / "in"))
        stream = self.spark.readStream.schema(EVENTS).parquet(str(self.home / "in"))
        campaigns.follow(campaigns.wave_changes(stream, once=once, **self.options), str(self.home / "out"), str(self.home / "state"))
        return campaigns.waves(self.changes())

    def changes(self):
        return campaigns.read_changes(self.spark, str(self.home / "out"))


def test_three_runs_with_late_events_equal_the_batch(spark, tmp_path):
    events = some_events(1) + [("c", 5000, at(3), "package_scanned", None), ("a", None, at(1), "note", None), ("a", 7000, None, "note", None)]
    ordered = sorted(events, key=lambda e: (e[2] is None, e[2] or START, e[1] or 0))
    late = [e for k, e in enumerate(ordered) if k % 9 == 0]
    rest = [e for k, e in enumerate(ordered) if k % 9]
    run = Run(spark, tmp_path, late="1 day", idle="3 days")
    parts = [rest[:300], rest[300:] + late[:20], late[20:]]
    for k in range(3):
        got = told(run(parts[k]))
        assert got == plain(sum(parts[: k + 1], []))
    assert got == told(campaigns.waves_of(spark.createDataFrame(events, EVENTS)))
    assert got["c"] == ("pending", 0, 1, 1, 0, 0, 0, 0.0, None, None, "5000") and None in got
    assert run.changes().where("closed").count() == 0


def test_a_wave_without_events_is_closed_and_starts_anew(spark, tmp_path):
    run = Run(spark, tmp_path, late="1 hour", idle="2 hours")
    first = [("a", k, at(k), "package_scanned", None) for k in range(40)] + [("a", 40, at(0), "wave_started", 100)]
    second = [("b", 100, at(600), "wave_started", 5)]
    third = [("a", 200, at(601), "wave_completed", None), ("a", 201, at(10), "package_scanned", None)]
    run(first)
    run(second)
    closed = run.changes().where("closed").select("wave", "n_events").collect()
    assert {r["wave"] for r in closed} == {"a"} and sum(r["n_events"] for r in closed) == 41
    assert told(run(third)) == plain(first + second + third[:1])


def test_events_that_come_twice_count_once_if_asked(spark, tmp_path):
    run = Run(spark, tmp_path)
    events = some_events(2, 60)
    run(events[:40] + events[:10], once=True)
    assert told(run(events[20:], once=True)) == plain(events)
    assert told(Run(spark, tmp_path / "each")(events + events[:30])) == plain(events + events[:30])


@pytest.mark.parametrize("seed", [3, 4])
def test_batch_equals_a_plain_fold(spark, seed):
    events = some_events(seed, 2000, ("a", "b", "c", "d", None))
    assert told(campaigns.waves_of(spark.createDataFrame(events, EVENTS))) == plain(events)
    assert campaigns.waves_of(spark.createDataFrame([], EVENTS)).count() == 0
