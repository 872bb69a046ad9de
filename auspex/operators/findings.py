"""Duplicates, patterns and statistics of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from auspex.functions import text as X

IDENTITY = ("package_name", "file_path", "line", "col", "category")


def deduplicated(findings: DataFrame) -> DataFrame:
    """One finding per place and category, the one of the greatest severity; with ties the first by description and code point."""
    order = Win.partitionBy(*IDENTITY).orderBy(X.severity_rank(F.col("severity")).desc(), "description", "code_point", F.col("confidence").desc_nulls_last())
    return findings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_per_code_point(findings: DataFrame) -> DataFrame:
    """One finding per place and code point."""
    order = Win.partitionBy("package_name", "file_path", "line", "col", "code_point").orderBy("category", "severity", "description", F.col("confidence").desc_nulls_last())
    return findings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dedup_stats(findings: DataFrame) -> DataFrame:
    """Rows before and after, and removed: a count per identity is enough."""
    each = findings.groupBy(*IDENTITY).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"), F.count("*").alias("n_after"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_removed"))


def patterns(findings: DataFrame) -> DataFrame:
    """Findings of one kind in a package: count, greatest severity, mean confidence (0.5 where none is given)."""
    rank = F.max(X.severity_rank(F.col("severity")))
    grouped = findings.groupBy("package_name", "category", "description").agg(F.count("*").alias("n"), rank.alias("rank"), F.avg(F.coalesce("confidence", F.lit(0.5))).alias("avg_confidence"))
    from auspex.functions.values import SEVERITIES

    return grouped.withColumn("max_severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank") + 1)).drop("rank")


def severity_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("package_name", "file_path").alias("n_files"))


def session_stats(findings: DataFrame) -> DataFrame:
    """Totals of a scan; info counts as low."""
    of = lambda *s: F.count_if(F.col("severity").isin(*s))
    return findings.agg(F.countDistinct("package_name", "file_path").alias("n_files"), of("critical").alias("n_critical"), of("high").alias("n_high"), of("medium").alias("n_medium"), of("low", "info").alias("n_low"))
