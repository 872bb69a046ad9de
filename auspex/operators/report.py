"""Reports over findings and scores, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
#: Levels, the gravest last.
GRAVITY = ("none", "note", "warning", "error")


def severity_pivot(findings: DataFrame) -> DataFrame:
    """A row per category, a column per severity."""
    return findings.groupBy("category").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES))


def sarif_levels(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file_path", "line", F.col("category").alias("rule_id"), X.lookup(F.col("severity"), LEVELS, "none").alias("level")).agg(F.count("*").alias("n"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """A result per line, as JSON of the interchange format's shape."""
    result = F.struct(
        F.col("category").alias("ruleId"),
        X.lookup(F.col("severity"), LEVELS, "none").alias("level"),
        F.struct(F.col("description").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    findings.select(F.to_json(result).alias("value")).write.text(path)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The rules block: a rule for each category with findings, its level the gravest of theirs, and a text of it."""
    grave = F.array_position(F.array(*map(F.lit, GRAVITY)), X.lookup(F.col("severity"), LEVELS, GRAVITY[0])).cast("int")
    grouped = findings.groupBy(F.col("category").alias("rule_id")).agg(F.max(grave).alias("_g"), F.min("description").alias("short_description"), F.count("*").alias("n"))
    return grouped.select("rule_id", F.element_at(F.array(*map(F.lit, GRAVITY)), F.col("_g")).alias("default_level"), "short_description", "n")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def flagged_packages(packages: DataFrame, findings: DataFrame) -> DataFrame:
    joined = packages.join(findings.select("package_name", "category", "severity"), "package_name", "left")
    rank = F.max(X.severity_rank(F.col("severity")))
    grouped = joined.groupBy("package_name").agg(F.count("category").alias("n_findings"), F.max("severity").alias("max_text"), rank.alias("r"))
    return grouped.withColumn("max_severity", F.when(F.col("r").isNotNull(), F.element_at(F.array(*map(F.lit, V.SEVERITIES)), F.col("r") + 1))).drop("r")


def detection_metrics(judged: DataFrame) -> DataFrame:
    """evidence_rate, fp_rate and their combination, of rows with ``flagged`` and ``positive``."""
    hit, fp = F.try_divide(F.count_if(F.col("flagged") & F.col("positive")), F.count_if("positive")), F.try_divide(F.count_if(F.col("flagged") & ~F.col("positive")), F.count_if(~F.col("positive")))
    return judged.agg(F.round(hit, 6).alias("evidence_rate"), F.round(fp, 6).alias("fp_rate"), F.round(0.6 * hit + 0.4 * (1 - fp), 6).alias("combined"))


def scan_rate(done, remaining, minutes):
    """Packages per minute and the seconds left; null where nothing was done."""
    rate = F.try_divide(done, minutes)
    return F.struct(rate.alias("per_minute"), F.try_divide(remaining * 60, F.nullif(rate, F.lit(0.0))).alias("eta_seconds"))
