"""Levels and cycles of waves against a plain loop."""

from __future__ import annotations

import random

import pytest

from auspex.operators import waves


def plain(names, needs):
    """State and level by taking waves off one by one."""
    known, needs = set(names), {(w, n) for w, n in needs if w in set(names)}
    unknown = {n for _, n in needs} - known
    nodes, needs = known | unknown, needs | {(u, u) for u in unknown}
    level, left = {}, set(nodes)
    while ready := {w for w in left if not any(a == w and n in left for a, n in needs)}:
        for w in ready:
            level[w] = max((level[n] + 1 for a, n in needs if a == w), default=0)
        left -= ready
    stuck = set(left)
    while ends := {w for w in stuck if not any(n == w and a in stuck for a, n in needs)}:
        stuck -= ends
    tangle = {w: w for w in stuck}
    for _ in stuck:
        for a, n in needs:
            if a in stuck and n in stuck:
                tangle[a] = tangle[n] = min(tangle[a], tangle[n])
    state = lambda w: "placed" if w in level else "blocked" if w not in stuck else "cycle" if w in known else "unknown"
    return {(w, state(w), level.get(w), tangle.get(w)) for w in nodes}


def found(spark, names, needs):
    given = spark.createDataFrame([(n, 1) for n in names], "wave string, state int"), spark.createDataFrame(needs, "wave string, needs string")
    rows = [tuple(r) for r in waves.wave_plan(*given).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_states_by_hand(spark):
    names = ["a", "b", "c", "d", "p", "q", "m", "s", "z", "y", "a", None]
    needs = [("b", "a"), ("c", "b"), ("c", "a"), ("c", "a"), ("p", "q"), ("q", "p"), ("m", "p"), ("s", "m"), ("s", "s"), ("z", "s"), ("y", "nowhere"), ("stranger", "a"), (None, "a"), ("b", None)]
    assert found(spark, names, needs) == {
        ("a", "placed", 0, None), ("b", "placed", 1, None), ("c", "placed", 2, None), ("d", "placed", 0, None), ("p", "cycle", None, "m"), ("q", "cycle", None, "m"), ("m", "cycle", None, "m"), ("s", "cycle", None, "m"),
        ("z", "blocked", None, None), ("y", "blocked", None, None), ("nowhere", "unknown", None, "nowhere"),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_equal_a_plain_loop(spark, seed):
    r = random.Random(seed)
    names = [f"w{k}" for k in range(60)]
    needs = [(f"w{a}", f"w{b}") for a, b in ((r.randrange(60), r.randrange(63)) for _ in range(55 + 10 * seed)) if a > b or r.random() < 0.25]
    assert found(spark, names, needs) == plain(names, needs)


def test_no_waves(spark):
    assert found(spark, [], []) == set()
    assert found(spark, ["a"], []) == {("a", "placed", 0, None)}
