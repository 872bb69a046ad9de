"""The queries on campaign state: one runs the stream over all events, one tells the same from a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auspex.plans.registered import query, table
from auspex.sources.shared import new_path
from auspex.streaming import campaigns


def campaign_events(events: DataFrame) -> DataFrame:
    """Ten waves by users; a signup starts a wave (again) with a plan, an error ends it, the rest are packages."""
    kinds = {"signup": "wave_started", "view": "package_scanned", "click": "package_flagged", "purchase": "package_malicious"}
    number = F.col("event_id")
    kind = F.coalesce(*(F.when(F.col("event_type") == e, k) for e, k in kinds.items()), F.when(number % 5 == 0, "wave_completed"), F.when(number % 5 == 1, "wave_failed"), F.lit("package_failed"))
    return events.select(F.concat(F.lit("wave"), (F.col("user_id") % 10).cast("string")).alias("wave"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.when(F.col("event_type") == "signup", number + 1000).alias("packages"))


_SQL = """WITH e AS (SELECT 'wave' || (user_id % 10) AS wave, event_id, ts, event_type AS t, event_id % 5 AS m, event_id + 1000 AS packages FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
g AS (SELECT wave, count(*) AS n_events, count(*) FILTER (t = 'view') AS scanned, count(*) FILTER (t = 'click') AS flagged, count(*) FILTER (t = 'purchase') AS malicious, count(*) FILTER (t = 'error' AND m > 1) AS failed,
min(ts) FILTER (t = 'signup') AS started_at, max(ts) AS last_at, coalesce(arg_max(packages, (ts, event_id)) FILTER (t = 'signup'), 0) AS total, arg_max(CASE WHEN t = 'signup' THEN 'running' WHEN m = 0 THEN 'completed' ELSE 'failed' END, (ts, event_id)) FILTER (t = 'signup' OR t = 'error' AND m < 2) AS status FROM e GROUP BY 1),
r AS (SELECT wave, string_agg(event_id, ',' ORDER BY ts DESC, event_id DESC) AS recent_ids FROM (SELECT *, row_number() OVER (PARTITION BY wave ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k <= 100 GROUP BY 1),
s AS (SELECT *, floor((epoch_us(last_at) - epoch_us(started_at)) / 1000000) AS seconds, greatest(total - scanned, 0) AS remaining FROM g)
SELECT wave, coalesce(status, 'pending') AS status, total::BIGINT AS packages_total, n_events, scanned, flagged, malicious, failed, round(CASE WHEN total > 0 THEN scanned / total * 100 ELSE 0 END, 6) AS progress, started_at, last_at,
round(CASE WHEN seconds > 0 THEN scanned / (seconds / 60) END, 6) AS rate_per_minute, (CASE WHEN seconds > 0 AND scanned > 0 AND remaining > 0 THEN floor(seconds::DOUBLE / scanned * remaining) END)::BIGINT AS eta_seconds, recent_ids FROM s JOIN r USING (wave)"""


@query("campaign_state", _SQL)
def campaign_state(spark, sf_dir):
    """All events through the stream's state; its watermark is behind all of them, since a table's files have no order."""
    schema = table(spark, sf_dir, "events").schema
    folder, name = sf_dir.rstrip("/"), "events.parquet"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
    sink = new_path(spark, "campaign")
    campaigns.follow(campaigns.wave_changes(campaign_events(stream), late="3650 days"), f"{sink}/changes", f"{sink}/state")
    return campaigns.waves(campaigns.read_changes(spark, f"{sink}/changes"))


@query("campaign_state_batch", _SQL)
def campaign_state_batch(spark, sf_dir):
    return campaigns.waves_of(campaign_events(table(spark, sf_dir, "events")))
