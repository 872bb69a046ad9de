"""Selection of what to scan: versions, samples, caches, checkpoints and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key: version policies, latest-wins upserts and per-package reports."""
    return rows.withColumn("_n", F.row_number().over(Win.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def upserted(table: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """``table`` with ``changes``: per key the row of the greatest version, of equal ones that of the changes."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, key, [F.col(version).desc(), F.col("_new").desc()]).drop("_new")


def pending(all_items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is left to scan after a restart."""
    return all_items.join(done.select(*key).distinct(), key, "left_anti")


def cache_lookup(items: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``items`` (key, content_hash) with hit, stale or miss by ``cache`` (key, content_hash, expires_at, result)."""
    entries = cache.select("key", F.col("content_hash").alias("_h"), "expires_at", "result")
    met = items.join(entries, "key", "left")
    state = F.when(F.col("_h").isNull() | (F.col("_h") != F.col("content_hash")), "miss").when(F.col("expires_at") > now, "hit").otherwise("stale")
    return met.withColumn("state", state).withColumn("result", F.when(F.col("state") == "hit", F.col("result"))).drop("_h", "expires_at")


def name_variants(names: DataFrame) -> DataFrame:
    """Six look-alike names of each package."""
    n = F.col("name")
    made = F.array(*(F.concat(n, F.lit(end)) for end in ("-js", "js", ".js", "-official", "-lib")), F.concat(F.lit("@"), n, F.lit("/core")))
    return names.select("name", F.explode(F.array_distinct(made)).alias("variant")).where("variant <> name")
