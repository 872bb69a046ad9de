"""Levels of waves that depend on each other, and what cycles keep from having one.

Waves without open needs are taken off in rounds, which gives levels; of what
is left, waves that nothing left needs are taken off in the same way, which
leaves those on cycles.  Each round joins the last one's waves with the edges and counts
down; it is one table in the shared folder, and nothing is collected.

Defined cases: repeated waves and edges count once; rows with a null take no part;
a wave that needs itself is on a cycle; a need that is no wave is a row
``unknown``, and keeps those that need it from a level as a cycle does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auspex.operators.components import components
from auspex.sources.shared import materialize, new_path, remove


def peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, round: the nodes that no edge (a, b) from a node that stays leads to, with the longest way to them; ``edges`` are distinct.

    A round's table has a folder of the nodes taken off and one of those that wait, which goes when the next round has read it.
    """
    spark = nodes.sparkSession
    schema = "node string, missing long, round int"

    def written(counted: DataFrame) -> str:
        path = new_path(spark, "waves")
        counted.withColumn("free", F.col("missing") == 0).write.partitionBy("free").parquet(path)
        return path

    def part(path: str, free: bool) -> DataFrame:
        return spark.read.schema(f"{schema}, free boolean").parquet(path).where(F.col("free") == free).drop("free")

    needs = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("missing"))
    paths = [written(nodes.join(needs, "node", "left").select("node", F.coalesce("missing", F.lit(0).cast("long")).alias("missing"), F.lit(0).alias("round")))]
    while not part(paths[-1], True).isEmpty():
        freed = edges.join(part(paths[-1], True).select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))
        counted = part(paths[-1], False).join(freed, "node", "left")
        after = written(counted.select("node", (F.col("missing") - F.coalesce("n", F.lit(0))).alias("missing"), F.lit(len(paths)).alias("round")))
        remove(spark, f"{paths[-1]}/free=false")
        paths.append(after)
    remove(spark, paths.pop())
    if not paths:
        return spark.createDataFrame([], schema).drop("missing")
    return spark.read.schema(schema).parquet(*(f"{p}/free=true" for p in paths)).drop("missing")


def wave_plan(waves: DataFrame, deps: DataFrame) -> DataFrame:
    """wave, state, level, tangle for ``waves`` (wave) and ``deps`` (wave, needs).

    ``placed`` waves have a level, the longest way from a wave without needs.  ``cycle``: on a
    cycle, or between cycles or unknown waves; the tangle, its connected waves' least name,
    is that of its members.  ``blocked`` waves need such ones, with none above them.
    """
    known = waves.select(F.col("wave").alias("node")).where("node is not null").distinct()
    given = deps.where("wave is not null and needs is not null").select(F.col("needs").alias("a"), F.col("wave").alias("b")).join(known.withColumnRenamed("node", "b"), "b", "left_semi").distinct()
    unknown = given.select(F.col("a").alias("node")).distinct().join(known, "node", "left_anti")
    nodes = materialize(known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False))), "wave-nodes")
    loops = nodes.where("not known").select(F.col("node").alias("a"), F.col("node").alias("b"))  # never taken off
    edges = materialize(given.select("a", "b").unionByName(loops), "wave-edges")
    placed = peeled(nodes, edges)
    left = materialize(nodes.join(placed, "node", "left_anti"), "waves-left")
    within = materialize(edges.join(left.select(F.col("node").alias("a")), "a", "left_semi"), "waves-left-edges")  # what a left wave leads to is left too
    blocked = peeled(left, within.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stuck = materialize(left.join(blocked, "node", "left_anti"), "waves-stuck")
    inner = within.join(stuck.select(F.col("node").alias("b")), "b", "left_semi")  # so are those that lead to a stuck one
    tangles = components(inner.select("a", "b"))
    named = stuck.join(tangles, "node", "left").select("node", F.when(F.col("known"), "cycle").otherwise("unknown").alias("state"), F.lit(None).cast("int").alias("level"), F.coalesce("root", "node").alias("tangle"))
    none = F.lit(None).cast("string")
    rows = placed.select("node", F.lit("placed").alias("state"), F.col("round").alias("level"), none.alias("tangle"))
    rows = rows.unionByName(blocked.select("node", F.lit("blocked").alias("state"), F.lit(None).cast("int").alias("level"), none.alias("tangle"))).unionByName(named)
    return rows.withColumnRenamed("node", "wave")


def level_of(waves: DataFrame, deps: DataFrame) -> DataFrame:
    """wave, level of the waves that have one."""
    return wave_plan(waves, deps).where("state = 'placed'").select("wave", "level")
