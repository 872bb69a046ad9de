"""The shape of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = ("package_name", "file_path", "line", "col", "code_point", "category", "severity", "description", "confidence")
KEY = ("package_name", "file_path")


def rows_of(df: DataFrame) -> DataFrame:
    """FINDING of a frame that has its columns or their constants as ``f``."""
    return df.select(*(F.col(c) if c in KEY else F.col(f"f.{c}") for c in FINDING))


def finding(line: Column, category: str, severity: Column | str, description: str, confidence: float | Column | None = None, col: Column | int = 1, code_point: Column | int = 0) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        line.cast("long").alias("line"),
        as_column(col).cast("long").alias("col"),
        as_column(code_point).cast("long").alias("code_point"),
        F.lit(category).alias("category"),
        as_column(severity).alias("severity"),
        F.lit(description).alias("description"),
        as_column(confidence).cast("double").alias("confidence"),
    )
