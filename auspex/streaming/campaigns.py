"""The state of scan campaigns as a stream: counters, status and last events of each wave, rate and time to go.

``wave_changes`` keeps a wave's state in ``transformWithStateInPandas``: a value of
counters, a value each of the events that decide on plan and status, a list of the
last events, and a timer that closes a wave which has had no event for ``idle``.  A
wave may have a third of all events, so it is held in SLICES parts by a hash of
the event's number; each trigger writes a part's new state as a row, and
``waves`` takes the newest row of every part and adds them up.

Every field is a sum, a least, or a greatest by (ts, event_id), so late
events and the order of files don't matter: as long as an event comes before the
watermark, a stream in any number of runs gives ``waves_of``, the same of a batch.

Defined cases: events without ``ts`` or ``event_id`` take no part; a null wave is
one of its own; kinds that aren't known are counted as events only; of events at the
same time the greater number is later; an event behind the watermark is dropped, and
one that comes twice counts twice, unless ``once`` is asked; a wave without
a start has no rate; a wave closed by its timer starts anew with its next event, and
``waves`` adds both up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Parts that a wave's state is held in.
SLICES = 32
#: Fixed value: so many events are remembered.
RECENT = 100
#: Kinds of events that are counted, and those that tell a wave's status.
COUNTED = {"package_scanned": "scanned", "package_flagged": "flagged", "package_malicious": "malicious", "package_failed": "failed"}
STATUS = {"wave_started": "running", "wave_completed": "completed", "wave_failed": "failed"}
NAMES = ("n_events", *COUNTED.values())
#: Times in the state are microseconds, which no time zone changes.
_PLAN, _LAST, _SEEN = "at long, event_id long, packages long", "at long, event_id long, kind string", "at long, event_id long"
_COUNTERS = f"opened long, version long, {', '.join(f'{n} long' for n in NAMES)}, started long, latest long, timer long"
_TOLD = f"{', '.join(f'{n} long' for n in NAMES)}, started long, latest long, plan struct<{_PLAN}>, last struct<{_LAST}>, recent array<struct<{_SEEN}>>"
CHANGES = f"wave string, slice int, opened long, version long, closed boolean, {_TOLD}"
_STATES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _greatest(state: tuple | None, rows: pd.DataFrame, column: str) -> tuple | None:
    """The later of ``state`` and the last of ``rows``."""
    if rows.empty:
        return state
    at, number, value = rows[["at", "event_id", column]].sort_values(["at", "event_id", column]).iloc[-1]
    found = (int(at), int(number), value if column == "kind" else int(value))
    return found if state is None else max(state, found)


def _value(state) -> tuple | None:
    return tuple(state.get()) if state.exists() else None


class _Wave(StatefulProcessor):
    """Folds the events of one part of a wave into its state; pandas adds up a batch before the state is touched."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", _COUNTERS)
        self.plan = handle.getValueState("plan", _PLAN)
        self.last = handle.getValueState("last", _LAST)
        self.recent = handle.getListState("recent", _SEEN)

    def _seen(self) -> list[tuple]:
        return [tuple(e) for e in self.recent.get()] if self.recent.exists() else []

    def _row(self, key, counters: tuple, closed: bool) -> pd.DataFrame:
        named = lambda value, third: value and dict(zip(("at", "event_id", third), value))
        plan, last = named(_value(self.plan), "packages"), named(_value(self.last), "kind")
        row = [key[0], key[1], *counters[:2], closed, *counters[2:-1], plan, last, [{"at": at, "event_id": number} for at, number in self._seen()]]
        names = ["wave", "slice", "opened", "version", "closed", *NAMES, "started", "latest", "plan", "last", "recent"]
        return pd.DataFrame({n: pd.Series([v], dtype="Int64" if n == "started" else "object" if n in ("wave", "plan", "last", "recent") else None) for n, v in zip(names, row)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        old, plan, last, recent = _value(self.counters), _value(self.plan), _value(self.last), self._seen()
        counts = list(old[2:-3]) if old else [0] * len(NAMES)
        started, latest = old[-3:-1] if old else (None, None)
        first = None
        for batch in rows:
            each = batch["kind"].value_counts()
            counts = [n + int(k) for n, k in zip(counts, [len(batch), *(each.get(kind, 0) for kind in COUNTED)])]
            starts = batch[batch["kind"] == "wave_started"]
            if len(starts):
                started = min(x for x in (started, int(starts["at"].min())) if x is not None)
            plan = _greatest(plan, starts[starts["packages"].notna()], "packages")
            last = _greatest(last, batch[batch["kind"].isin(list(STATUS))], "kind")
            newest = batch.sort_values(["at", "event_id"]).tail(RECENT)
            recent = sorted(recent + list(zip(newest["at"].tolist(), newest["event_id"].tolist())))[-RECENT:]
            first = min(x for x in (first, int(batch["at"].min())) if x is not None)
            latest = max(x for x in (latest, int(batch["at"].max())) if x is not None)
        due = latest // 1000 + self.idle_ms
        if old and old[-1] != due:
            self.handle.deleteTimer(old[-1])
        if not old or old[-1] != due:
            self.handle.registerTimer(due)
        opened, version = old[:2] if old else (first, 0)
        counters = (opened, version + 1, *counts, started, latest, due)
        self.counters.update(counters)
        for state, value in ((self.plan, plan), (self.last, last)):
            if value is not None:
                state.update(value)
        self.recent.put(recent)
        yield self._row(key, counters, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        counters = _value(self.counters)
        if counters:
            yield self._row(key, (counters[0], counters[1] + 1, *counters[2:]), True)
            for state in (self.counters, self.plan, self.last, self.recent):
                state.clear()

    def close(self) -> None:
        pass


def _parts(events: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64("event_id"), F.lit(SLICES)).cast("int")
    return events.where("ts IS NOT NULL AND event_id IS NOT NULL").select("wave", part.alias("slice"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "kind", "packages")


def wave_changes(events: DataFrame, late: str = "1 day", idle: str = "7 days", once: bool = False) -> DataFrame:
    """A row (CHANGES) for each change of a part of a wave, from a stream of events (wave, event_id, ts, kind, packages).

    ``version`` counts a part's rows since it was ``opened``; with ``once``, events
    whose number came before, within ``late``, are left out.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = events.withWatermark("ts", late)
    timed = timed.dropDuplicatesWithinWatermark(["event_id"]) if once else timed
    return _parts(timed).groupBy("wave", "slice").transformWithStateInPandas(statefulProcessor=_Wave(idle_ms), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def follow(changes: DataFrame, sink: str, checkpoint: str) -> None:
    """Append to ``sink`` what the stream ``changes`` has now; run again with the same ``checkpoint``, it goes on from there."""
    spark, key = changes.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _STATES)
    try:
        query = changes.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def read_changes(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(sink)


def waves(changes: DataFrame) -> DataFrame:
    """The state of each wave by the newest change of each of its parts; ``_told`` has the columns."""
    fields = ("version", *NAMES, "started", "latest", "plan", "last", "recent")
    newest = changes.groupBy("wave", "slice", "opened").agg(F.max_by(F.struct(*fields), "version").alias("s"))
    return _told(newest.select("wave", "s.*"))


def waves_of(events: DataFrame) -> DataFrame:
    """What ``waves`` tells after all of ``events``, from a batch: parts of waves first, then waves."""
    parts = _parts(events)
    kind = F.col("kind")
    plan = F.when((kind == "wave_started") & F.col("packages").isNotNull(), F.struct("at", "event_id", "packages"))
    last = F.when(kind.isin(*STATUS), F.struct("at", "event_id", "kind"))
    counts = [F.count("*").alias("n_events"), *(F.count_if(kind == k).alias(name) for k, name in COUNTED.items())]
    told = parts.groupBy("wave", "slice").agg(*counts, F.min(F.when(kind == "wave_started", F.col("at"))).alias("started"), F.max("at").alias("latest"), F.max(plan).alias("plan"), F.max(last).alias("last"))
    place = F.row_number().over(Window.partitionBy("wave", "slice").orderBy(F.desc("at"), F.desc("event_id")))
    newest = parts.select("wave", "slice", "at", "event_id", place.alias("k")).where(F.col("k") <= RECENT)
    recent = newest.groupBy(F.col("wave").alias("_w"), F.col("slice").alias("_s")).agg(F.collect_list(F.struct("at", "event_id")).alias("recent"))
    return _told(told.join(recent, F.col("wave").eqNullSafe(F.col("_w")) & (F.col("slice") == F.col("_s"))).drop("_w", "_s"))


def _told(parts: DataFrame) -> DataFrame:
    """wave, status, packages_total, counters, progress (percent), started_at, last_at, rate_per_minute, eta_seconds (null if nothing is left or nothing was scanned), recent_ids (newest first).

    Rate and time to go are those at the wave's last event.
    """
    each = parts.groupBy("wave").agg(*(F.sum(n).alias(n) for n in NAMES), F.min("started").alias("started"), F.max("latest").alias("latest"), F.max("plan").alias("plan"), F.max("last").alias("last"), F.flatten(F.collect_list("recent")).alias("recent"))
    total, scanned = F.coalesce(F.col("plan.packages"), F.lit(0)), F.col("scanned")
    seconds = F.floor((F.col("latest") - F.col("started")) / 1_000_000)
    left = F.greatest(total - scanned, F.lit(0))
    eta: Column = F.when((seconds > 0) & (scanned > 0) & (left > 0), F.floor(seconds.cast("double") / scanned * left))
    status = F.coalesce(*(F.when(F.col("last.kind") == kind, name) for kind, name in STATUS.items()), F.lit("pending"))
    ids = F.transform(F.slice(F.reverse(F.array_sort("recent")), 1, RECENT), lambda e: e["event_id"].cast("string"))
    return each.select(
        "wave", status.alias("status"), total.cast("long").alias("packages_total"), *NAMES,
        F.round(F.when(total > 0, scanned / total * 100).otherwise(0.0), 6).alias("progress"),
        F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("latest").alias("last_at"),
        F.round(F.when(seconds > 0, scanned / (seconds / 60)), 6).alias("rate_per_minute"), eta.cast("long").alias("eta_seconds"), F.array_join(ids, ",").alias("recent_ids"),
    )
