"""Summaries of scans: counts, rates per wave with their total, levels with what to do, rules for another scanner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(findings: DataFrame, *columns: str) -> DataFrame:
    """Number of findings by each of the columns: kind (the column), name, n; one shuffle for all."""
    sets = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in columns)))
    return findings.select(sets.alias("s")).groupBy("s.kind", "s.name").agg(F.count("*").alias("n"))


def wave_rates(scans: DataFrame) -> DataFrame:
    """Of ``scans`` (wave, flagged, malicious): counts and percentages for each wave, and for all as the wave 'total'."""
    rate = lambda of: F.round(100.0 * F.count_if(of) / F.count("*"), 6)
    rolled = scans.rollup("wave").agg(
        F.grouping("wave").alias("all"), F.count("*").alias("n_scanned"), F.count_if("flagged").alias("n_flagged"), F.count_if("malicious").alias("n_malicious"), rate(F.col("flagged")).alias("flag_rate"), rate(F.col("malicious")).alias("malicious_rate")
    )
    return rolled.withColumn("wave", F.when(F.col("all") == 1, "total").otherwise(F.col("wave"))).drop("all")


def markdown_rows(rates: DataFrame) -> DataFrame:
    """A Markdown table's row for each row of ``wave_rates``."""
    return rates.select("wave", F.format_string("| %s | %d | %d | %d | %.1f%% | %.1f%% |", F.coalesce("wave", F.lit("")), "n_scanned", "n_flagged", "n_malicious", "flag_rate", "malicious_rate").alias("markdown"))


def risk_level(score: Column) -> Column:
    return F.when(score >= 100, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").when(score >= 10, "LOW").otherwise("MINIMAL")


def risk_action(score: Column) -> Column:
    return F.when(score >= 100, "IMMEDIATE_INVESTIGATION").when(score >= 50, "PRIORITY_REVIEW").when(score >= 25, "REVIEW").when(score >= 10, "MONITOR").otherwise("IGNORE")


def should_flag(score: Column) -> Column:
    return score >= 10


def yara_rules(patterns: DataFrame) -> DataFrame:
    """A rule's source for each ``rule`` of ``patterns`` (rule, identifier, value): any of its strings, in the order of identifiers.

    Quotes and backslashes of values are escaped; null values are left out.
    """
    escaped = F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = F.concat(F.lit("        $"), "identifier", F.lit(' = "'), escaped, F.lit('"'))
    strings = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("identifier", line.alias("line")))), lambda s: s["line"]), "\n")
    body = F.concat(F.lit("rule "), "rule", F.lit("\n{\n    strings:\n"), "_strings", F.lit("\n    condition:\n        any of them\n}"))
    return patterns.where("value IS NOT NULL").groupBy("rule").agg(strings.alias("_strings")).select("rule", body.alias("source"))
