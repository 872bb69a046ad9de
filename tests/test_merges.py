"""Ordered merges of shared infrastructure against a plain loop over the values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from auspex.operators import merges

SHARED = "package_name string, kind string, value string"


def plain(rows):
    """(cluster, package) by going through the values one at a time."""
    packages = {}
    for package, kind, value in rows:
        if package is not None and kind is not None and value:
            packages.setdefault((kind, value), set()).add(package)
    place = lambda k: (merges.KINDS.index(k) if k in merges.KINDS else 3, k)
    clusters = []
    for kind, value in sorted(packages, key=lambda x: (place(x[0]), x[1])):
        mine = packages[kind, value]
        if len(mine) > 1:
            for _, held in clusters:
                if held & mine:
                    held |= mine
                    break
            else:
                clusters.append((f"{kind}:{value}", set(mine)))
    return {(name, p) for name, held in clusters for p in held}


def found(spark, rows):
    return {(r["cluster"], r["package_name"]) for r in merges.ordered_clusters(spark.createDataFrame(rows, SHARED)).collect()}


def test_a_value_joins_only_the_first_cluster_it_overlaps(spark):
    rows = [("p", "domain", "a"), ("q", "domain", "a"), ("r", "domain", "b"), ("s", "domain", "b"), ("q", "wallet", "w"), ("r", "wallet", "w"), ("t", "author", "x"), ("s", "author", "x"), ("lone", "author", "y")]
    want = {("domain:a", "p"), ("domain:a", "q"), ("domain:a", "r"), ("domain:b", "r"), ("domain:b", "s"), ("domain:b", "t")}
    assert found(spark, rows) == plain(rows) == want
    assert found(spark, rows[::-1] + rows + [(None, "domain", "a"), ("p", None, "a"), ("p", "wallet", None), ("p", "wallet", ""), ("q", "wallet", "")]) == want


def test_order_is_by_kind_then_value(spark):
    rows = [("p", "author", "a"), ("q", "author", "a"), ("q", "domain", "z"), ("r", "domain", "z"), ("r", "other", "0"), ("s", "other", "0")]
    assert found(spark, rows) == {("domain:z", x) for x in "pqrs"}


@pytest.mark.parametrize("seed,n_packages,n_values", [(1, 40, 60), (2, 150, 90), (3, 300, 200)])
def test_random_infrastructure_equals_the_plain_loop(spark, seed, n_packages, n_values):
    rng = random.Random(seed)
    rows = [(f"p{rng.randrange(n_packages)}", rng.choice(merges.KINDS), f"v{rng.randrange(n_values)}") for _ in range(n_packages)]
    want = plain(rows)
    assert found(spark, rows) == want and len({c for c, _ in want}) > 2


def test_a_package_of_a_third_of_all_rows_and_a_long_chain(spark):
    rows = [("hot", "domain", f"d{k:04d}") for k in range(900)] + [(f"q{k}", "domain", f"d{k:04d}") for k in range(900)]
    rows += [(f"c{k}", "wallet", f"w{k:03d}") for k in range(300)] + [(f"c{k}", "wallet", f"w{k + 1:03d}") for k in range(300)]
    assert found(spark, rows) == plain(rows)


def test_neighbours_are_the_same_over_all_levels_of_blocks(spark, monkeypatch):
    rng = random.Random(5)
    held = sorted({(f"p{rng.randrange(3)}", rng.randrange(4000)) for _ in range(900)})
    want = {(v, u) for (p, u), (q, v) in zip(held, held[1:]) if p == q}
    monkeypatch.setattr(merges, "SHIFTS", (3, 6, 9))
    got = merges.steps(spark.createDataFrame(held, "package_name string, v long"))
    assert {(r["v"], r["u"]) for r in got.collect()} == want and got.count() == len(want)


def test_no_rows_and_reuse(spark):
    rows = spark.createDataFrame([("p", "domain", "a"), ("q", "domain", "a"), ("q", "domain", "a"), ("q", "wallet", "w"), ("q", "wallet", "")], SHARED)
    assert merges.ordered_clusters(rows.limit(0)).count() == 0
    assert merges.ordered_clusters(rows.where("kind = 'wallet'").withColumn("cluster", F.lit(1))).count() == 0
    assert sorted(tuple(r) for r in merges.reuse(rows).collect()) == [("domain", 1, 1, 2.0), ("wallet", 1, 0, 1.0)]
