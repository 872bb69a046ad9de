"""Version policies against a plain loop."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from auspex.operators import policies

VERSIONS, POLICIES = "package_name string, version string, published timestamp", "package_name string, policy string"
NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def plain(versions, policy, by_date=True):
    newest = sorted(versions, key=lambda v: (v[1] is None, -(v[1] or NOW).timestamp(), v[0]))
    if policy is None:
        return {v for v, _ in newest[:10]}
    if policy == "all":
        return {v for v, _ in newest}
    if policy.startswith("last-"):
        n, days = policy[5:].removesuffix("d"), policy.endswith("d")
        if not (n.isascii() and n.isdigit()):
            return set()
        if days and by_date:
            return {v for v, t in newest if t and t >= NOW - timedelta(days=min(int(n), 9999))}
        return {v for v, _ in newest[: 10 if days else int(n)]}
    return {v.strip() for v in policy.split(",")} & {v for v, _ in versions}


@pytest.mark.parametrize("by_date", [True, False])
def test_policies_equal_the_plain_loop(spark, by_date):
    rng = random.Random(8)
    told = {"hot": "last-7", "hot2": "all", "none": None, "days": "last-30d", "zero": "last-0", "list": "1.0.3, 1.0.5,9.9,1.0.3", "bad": "last-x", "bad2": "last-", "bad3": "last--3", "day0": "last-0d", "long": "last-123456789012345678901", "ages": "last-999999999999999999d", "": "all"}
    held = {p: [(f"1.0.{k}", None if rng.random() < 0.1 else NOW - timedelta(days=rng.randrange(60), hours=rng.choice([0, 0, 5]))) for k in range(1500 if p.startswith("hot") else 25)] for p in [*told, "unnamed"]}
    rows = [(p, v, t) for p, vs in held.items() for v, t in vs]
    rows += rows[:40] + [("days", "created", NOW), ("hot2", "modified", NOW), (None, "1", NOW), ("days", None, NOW)]
    rows = spark.createDataFrame(rows, VERSIONS).withColumn("held", F.lit("x")).withColumn("n", F.lit(1))
    policy = spark.createDataFrame([*told.items(), ("hot", "last-7"), (None, "all"), ("gone", "all")], POLICIES)
    got = {}
    for r in policies.sampled_versions(rows, policy, F.lit(NOW), days_by_date=by_date).collect():
        assert r["version"] not in got.setdefault(r["package_name"], set())
        got[r["package_name"]].add(r["version"])
    want = {p: plain(vs, "last-x" if p == "long" else told.get(p), by_date) for p, vs in held.items()}
    assert got == {p: v for p, v in want.items() if v}
    assert {r["package_name"] for r in policies.faulty(policy).collect()} == {"bad", "bad2", "bad3", "long"}


def test_no_rows(spark):
    versions, policy = spark.createDataFrame([], VERSIONS), spark.createDataFrame([], POLICIES)
    assert policies.sampled_versions(versions, policy, F.lit(NOW)).count() == 0 and policies.faulty(policy).count() == 0
