"""Module imports as a graph: edges, resolution, reachability and shortest paths by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auspex.sources.shared import materialize

#: Import forms; the last group is the module.
IMPORTS = (
    r"import\s*\{[^}]+\}\s*from\s*['\"]([^'\"]+)['\"]",
    r"import\s+\w+\s+from\s*['\"]([^'\"]+)['\"]",
    r"import\s*\*\s*as\s+\w+\s+from\s*['\"]([^'\"]+)['\"]",
    r"(?:const|let|var)\s+\w+\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
)
#: In the order in which a module's file is looked for.
ENDINGS = ("", ".js", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts")


def import_edges(files: DataFrame) -> DataFrame:
    """package_name, from_file, module, form: relative imports of each file."""
    each = [F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), _tagged(n)) for n, p in enumerate(IMPORTS)]
    edges = files.select("package_name", F.col("file_path").alias("from_file"), F.explode(F.concat(*each)).alias("e"))
    return edges.select("package_name", "from_file", F.col("e.module").alias("module"), F.col("e.form").alias("form")).where(F.col("module").startswith("."))


def _tagged(form: int):
    return lambda m: F.struct(m.alias("module"), F.lit(form).alias("form"))


def normal_path(path):
    """A path without ``.`` and, as far as there are folders for them, ``..`` steps."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != ".") & (x != ""))
    up = lambda out, x: F.when((x == "..") & (F.size(out) > 0) & (F.get(out, F.size(out) - 1) != ".."), F.slice(out, 1, F.size(out) - 1)).otherwise(F.concat(out, F.array(x)))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")


def resolved(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The file that each relative import means: the first candidate that exists in the package."""
    target = normal_path(F.concat(F.regexp_extract("from_file", r"^(.*/)[^/]*$", 1), F.col("module")))
    candidates = edges.withColumn("_c", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.concat(target, F.lit(e)).alias("path")) for k, e in enumerate(ENDINGS)))))
    known = files.select(F.col("package_name").alias("_p"), F.col("file_path").alias("to_file"))
    met = candidates.join(known, (F.col("package_name") == F.col("_p")) & (F.col("_c.path") == F.col("to_file")))
    return met.groupBy("package_name", "from_file", "module", "form").agg(F.min_by("to_file", F.col("_c.k")).alias("to_file"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, source, distance, parent: all that can be reached over ``edges`` (a, b) from ``sources`` (node), and the least node before it on a shortest way.

    Each step joins the frontier with the edges and drops what was reached before,
    until it is empty.  Steps are tables of one folder's files, read together.
    """
    reached = [materialize(sources.select("node", F.col("node").alias("source"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")), "reach")]
    while not reached[-1].isEmpty():
        moved = reached[-1].join(edges, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node"), "source").agg(F.min("node").alias("parent"))
        before = edges.sparkSession.read.schema(reached[0].schema).parquet(*(t.table_path for t in reached))
        step = moved.join(before.select("node", "source"), ["node", "source"], "left_anti").select("node", "source", F.lit(len(reached)).alias("distance"), "parent")
        reached.append(materialize(step, "reach"))
    return edges.sparkSession.read.schema(reached[0].schema).parquet(*(t.table_path for t in reached))


def shortest_paths(reached: DataFrame) -> DataFrame:
    """node, source, distance, path (nodes from source to node): rows of ``distances`` joined to their parents, one step at a time."""
    path = reached.where("distance = 0").select("node", "source", "distance", F.array("node").alias("path"))
    longest = reached.agg(F.max("distance")).first()[0] or 0
    found = [materialize(path, "paths")]
    for step in range(1, longest + 1):
        before = found[-1].select(F.col("node").alias("parent"), "source", F.col("path").alias("_before"))
        now = reached.where(F.col("distance") == step).join(before, ["parent", "source"])
        found.append(materialize(now.select("node", "source", "distance", F.concat("_before", F.array("node")).alias("path")), "paths"))
    return reached.sparkSession.read.schema(found[0].schema).parquet(*(t.table_path for t in found))


def importers(edges: DataFrame, target: DataFrame) -> DataFrame:
    """The files that import a file of ``target`` (package_name, to_file)."""
    return edges.join(target.select("package_name", "to_file").distinct(), ["package_name", "to_file"], "left_semi")
