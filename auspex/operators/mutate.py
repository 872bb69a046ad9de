"""Inert text mutations, and how many of them a quick literal rule set misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X

#: Rules that the mutations are tried on.
WATCHED = ("eval(", "createDecipheriv", "process.exit", "fromCharCode", "X-Exfil-ID")
#: Latin letters and their look-alikes, in order.
LATIN, ALIKE = "aeopcxy", "аеорсху"
ZERO_WIDTH = ("​‌‍", "‌‍​")

#: Name, Spark expression of ``content``, DuckDB's.
STRATEGIES = (
    ("none", lambda c: c, "content"),
    ("look_alike_letters", lambda c: F.translate(c, LATIN, ALIKE), f"translate(content, '{LATIN}', '{ALIKE}')"),
    ("rotated_zero_width", lambda c: F.translate(c, *ZERO_WIDTH), f"translate(content, '{ZERO_WIDTH[0]}', '{ZERO_WIDTH[1]}')"),
    ("renamed_decoder", lambda c: F.replace(F.replace(c, F.lit("createDecipheriv"), F.lit("makeReader")), F.lit("fromCharCode"), F.lit("toText")), "replace(replace(content, 'createDecipheriv', 'makeReader'), 'fromCharCode', 'toText')"),
    ("spaced_calls", lambda c: F.replace(c, F.lit("("), F.lit(" (")), "replace(content, '(', ' (')"),
)


def mutated(files: DataFrame) -> DataFrame:
    """Each file that a watched rule finds, once per strategy."""
    caught = files.where(X.contains_any(F.col("content"), WATCHED))
    each = F.array(*(F.struct(F.lit(n).alias("strategy"), f(F.col("content")).alias("content")) for n, f, _ in STRATEGIES))
    return caught.select("package_name", "file_path", F.explode(each).alias("m")).select("package_name", "file_path", "m.strategy", "m.content")


def evasion_rate(tried: DataFrame) -> DataFrame:
    evaded = ~X.contains_any(F.col("content"), WATCHED)
    return tried.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if(evaded).alias("n_evaded"), F.round(F.count_if(evaded) / F.count("*"), 6).alias("evasion_rate"))


_any = "(" + " OR ".join(f"contains(content, '{w}')" for w in WATCHED) + ")"
SQL = f"caught AS (SELECT content FROM corpus WHERE {_any}), tried AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, {s} AS content FROM caught" for n, _, s in STRATEGIES) + f"), evasion AS (SELECT strategy, NOT {_any} AS evaded FROM tried)"
