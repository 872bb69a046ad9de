"""Lines and columns of places in texts, counted in characters from 1; a line ends with \\n."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_ends(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def after_last_end(text: Column) -> Column:
    """Characters behind the last line end, all without one."""
    return F.length(F.substring_index(text, "\n", -1)).cast("long")


def place_of(content: Column, literal: Column) -> Column:
    """(line, col) of the first occurrence of ``literal``; null without one."""
    before = F.substring(content, F.lit(1), F.call_function("instr", content, literal) - 1)
    return F.when(F.contains(content, literal), F.struct((line_ends(before) + 1).alias("line"), (after_last_end(before) + 1).alias("col")))


_PLACES = T.StructType([T.StructField(name, T.ArrayType(T.LongType())) for name in ("line", "col")])


@F.pandas_udf(_PLACES)
def _places(ends: pd.Series, tail: pd.Series, length: pd.Series) -> pd.DataFrame:
    """Of texts that follow one another: line and column behind each, from their line ends, the characters behind the last and all characters."""
    lines, cols = [], []
    for e, t, n in zip(ends, tail, length, strict=True):
        e, t, n = (np.asarray(x, np.int64) for x in (e, t, n))
        sums, at = np.cumsum(n), np.arange(len(e))
        last = np.maximum.accumulate(np.where(e > 0, at, -1))  # the text that has the last line end
        lines.append(1 + np.cumsum(e))
        cols.append(1 + np.where(last >= 0, t[last] + sums - sums[last], sums))
    return pd.DataFrame({"line": lines, "col": cols})


def statements(files: DataFrame, patterns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """package_name, file_path with each match (found) of each of ``patterns`` in content: its name and pattern, its line and column, and the text from it to the next match of that pattern (after).

    A pattern comes with a literal that its matches can't do without, or None; files
    are read once for all patterns.  A file without content has no match; equal files
    have equal rows each.  Places are prefix sums over the texts between matches:
    only three numbers a match leave the JVM for them.
    """
    named = lambda name, pattern: F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("m"))
    each = [named(n, p) if sign is None else F.when(F.contains("content", F.lit(sign)), named(n, p)) for n, (p, sign) in patterns.items()]
    met = files.select("package_name", "file_path", "content", F.inline(F.filter(F.array(*each), lambda x: F.size(x["m"]) > 0)))
    met = met.select("package_name", "file_path", F.inline(F.array(F.struct("name", "pattern", "m", F.split("content", F.col("pattern"), -1).alias("between")))))
    # the text that each match adds to what lies before it: the match before, and all up to it
    added = F.transform("m", lambda x, k: F.concat(F.coalesce(F.get("m", k - 1), F.lit("")), F.get("between", k)))
    met = met.select("package_name", "file_path", F.inline(F.array(F.struct("name", "pattern", "m", F.slice("between", 2, F.size("m")).alias("after"), F.transform(added, lambda t: F.struct(line_ends(t).alias("e"), after_last_end(t).alias("t"), F.length(t).cast("long").alias("n"))).alias("_s")))))
    met = met.withColumn("_at", _places(F.col("_s.e"), F.col("_s.t"), F.col("_s.n")))
    rows = F.arrays_zip("m", F.col("_at.line").alias("line"), F.col("_at.col").alias("col"), "after")
    return met.select("package_name", "file_path", "name", "pattern", F.inline(rows).alias("found", "line", "col", "after"))
