"""Clusters of packages by ordered merges: each shared value joins the first cluster that it overlaps.

Values come in order: domains, then wallets, then authors, each kind by value.  A
value of several packages goes to the oldest cluster that holds one of them, or
founds one; a cluster is not joined with a second one that a value overlaps too, so
a package may be in several.  Done one value at a time, this is a loop over all of
the corpus.  Here it is a search: a value's cluster is the least value that a way of
falling values leads to, each step between two values of one package.  (The value's
cluster is the least of those of its earlier neighbours, and so on down.)  It is
enough to step to the package's value just before, so a package of n values makes
n - 1 steps.

Defined cases: repeated rows count once; rows with a null or an empty value take no
part; a value of one package makes no cluster; kinds beyond the three come after
them, by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auspex.sources.shared import discard, join_keyed, materialize

KINDS = ("domain", "wallet", "author")
#: Neighbours are looked up in blocks of 2^10 places, then among blocks, 2^10 blocks a time, then among ranges and all that is left.
SHIFTS = (10, 20, 33)
MAX_ROUNDS = 200


def numbered(shared: DataFrame) -> DataFrame:
    """kind, value, v, n: the values of several packages, with numbers that keep their order, and how many packages they have."""
    each = shared.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = F.when(place == 0, len(KINDS) + 1).otherwise(place)
    sorted_ = each.withColumn("_k", order).repartitionByRange("_k", "kind", "value").sortWithinPartitions("_k", "kind", "value")
    return sorted_.select("kind", "value", F.monotonically_increasing_id().alias("v"), "n")


def steps(held: DataFrame) -> DataFrame:
    """v, u: for each package's values (package_name, v) the one just before.

    No task gets all values of a package: neighbours are found in blocks of places,
    then the first of a block after the last of the block before, and so on up.
    """
    level = held.select("package_name", F.col("v").alias("low"), F.col("v").alias("high"))
    found = []
    for shift in (*SHIFTS, None):
        block = [F.shiftright("low", shift).alias("_b")] if shift else []
        keys = ["package_name", *(["_b"] if shift else [])]
        with_block = level.select("*", *block)
        before = F.lag("high").over(Window.partitionBy(*keys).orderBy("low"))
        found.append(with_block.select(F.col("low").alias("v"), before.alias("u")).where("u IS NOT NULL"))
        if shift:
            level = with_block.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_b")
    return reduce(DataFrame.unionByName, found).distinct()


def _least(state: DataFrame, links: DataFrame) -> DataFrame:
    """v, c: the least of each value's own cluster and those of the values ``u`` that it steps to (v, u, and n of each u in ``state``)."""
    near = join_keyed(links.select("v", "u"), state.select(F.col("v").alias("u"), "c", "degree"), "u", "degree").select("v", "c")
    best = near.groupBy("v").agg(F.min("c").alias("m"))
    return state.join(best, "v", "left").select("v", F.least("c", "m").alias("c"), "degree", F.col("c").alias("was"))


def founders(values: DataFrame, links: DataFrame) -> DataFrame:
    """v, c: the founding value of each value's cluster.

    A round looks one step down, then goes on to what the value found there had
    found itself, so that ways of n steps take about log n rounds where they don't branch.
    Nothing is collected but the number of values that changed.
    """
    degree = links.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("degree"))
    state = materialize(values.select("v", F.col("v").alias("c")).join(degree, "v", "left").fillna(0, ["degree"]), "founders")
    for _ in range(MAX_ROUNDS):
        stepped = materialize(_least(state, links), "founders")
        asked = stepped.groupBy("c").agg(F.count("*").alias("asking"))
        jumps = materialize(stepped.where("c < v").select(F.col("v").alias("c"), F.col("c").alias("to")).join(asked, "c"), "founders")
        after = materialize(join_keyed(stepped, jumps, "c", "asking", "left").select("v", F.coalesce("to", "c").alias("c"), "degree", "was"), "founders")
        changed = after.agg(F.count_if(F.col("c") < F.col("was"))).first()[0]
        discard(state, stepped, jumps)
        state = after
        if not changed:
            return state.select("v", "c")
    raise RuntimeError(f"no clusters after {MAX_ROUNDS} rounds")


def ordered_clusters(shared: DataFrame) -> DataFrame:
    """cluster, package_name, n_values: the packages of each cluster, which is named by the value that founded it (``kind:value``), and how many of its values each has.

    ``shared`` holds package_name, kind and value.
    """
    distinct = materialize(shared.select("package_name", "kind", "value").where("package_name IS NOT NULL AND kind IS NOT NULL AND value <> ''").distinct(), "shared")
    values = materialize(numbered(distinct), "values")
    named = values.select(F.struct("kind", "value").alias("key"), "v", "n")
    held = materialize(join_keyed(distinct.select("package_name", F.struct("kind", "value").alias("key")), named, "key", "n").select("package_name", "v", "n"), "held")
    links = materialize(steps(held), "steps")
    found = founders(values, links)
    of_value = values.join(found, "v").select("v", "n", "c")
    members = join_keyed(held.select("package_name", "v"), of_value, "v", "n").groupBy("c", "package_name").agg(F.count("*").alias("n_values"))
    names = values.join(found.where("v = c").select("v"), "v").select(F.col("v").alias("c"), F.concat_ws(":", "kind", "value").alias("cluster"))
    sized = names.join(members.groupBy("c").agg(F.count("*").alias("size")), "c")
    return join_keyed(members, sized, "c", "size").select("cluster", "package_name", "n_values")


def reuse(shared: DataFrame) -> DataFrame:
    """kind, n_values, n_reused, avg_packages: how many values of each kind there are, how many several packages have, and the mean number of packages."""
    each = shared.where("package_name IS NOT NULL AND kind IS NOT NULL AND value <> ''").select("package_name", "kind", "value").distinct().groupBy("kind", "value").agg(F.count("*").alias("n"))
    return each.groupBy("kind").agg(F.count("*").alias("n_values"), F.count_if(F.col("n") > 1).alias("n_reused"), F.round(F.avg("n"), 6).alias("avg_packages"))
