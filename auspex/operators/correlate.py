"""Correlation of findings: chains in a file, over packages, and campaign signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V

EXECUTES = r"(?i)(eval|function\(|dynamic execution|vm\.run|exec)"


def attack_chains(findings: DataFrame) -> DataFrame:
    """The chain of each file, the first kind that fits: its confidence, steps and greatest severity."""
    cat = lambda *c: F.bool_or(F.col("category").isin(*c))
    flags = findings.groupBy("package_name", "file_path").agg(
        cat("stegano_payload", "invisible_character", "stego_pattern").alias("stego"),
        cat("decoder_function", "stego_pattern").alias("decoder"),
        F.bool_or(F.col("description").rlike(EXECUTES)).alias("exec"),
        cat("encrypted_payload").alias("encrypted"),
        F.count_distinct(F.when(F.col("category").isin("encrypted_payload", "hardcoded_key_decryption", "rc4_pattern"), F.col("category"))).alias("n_decrypt"),
        cat("header_c2").alias("header"),
        cat("blockchain_c2").alias("chain"),
        cat("locale_geofencing", "time_delay_sandbox_evasion").alias("geo"),
        F.count("*").alias("n_steps"),
        F.max(X.severity_rank(F.col("severity"))).alias("rank"),
    )
    kind = F.when(F.col("stego") & F.col("decoder") & F.col("exec"), "stego").when(F.col("encrypted") & F.col("exec"), "encrypted_exec").when(F.col("header"), "header_c2").when(F.col("chain"), "blockchain_c2").when(F.col("geo"), "geofenced_exec")
    confidence = F.when(F.col("kind").isin("stego", "header_c2"), 0.95).when(F.col("kind") == "encrypted_exec", F.when(F.col("n_decrypt") >= 2, 0.9).otherwise(0.75)).when(F.col("kind") == "blockchain_c2", 0.9).otherwise(F.when(F.col("exec"), 0.85).otherwise(0.7))
    severity = F.element_at(F.array(*map(F.lit, V.SEVERITIES)), F.col("rank") + 1)
    return flags.withColumn("kind", kind).where("kind is not null").select("package_name", "file_path", "kind", confidence.alias("confidence"), "n_steps", severity.alias("severity"))


def threat_scores(chains: DataFrame) -> DataFrame:
    """Chains of a package added up, 10 at most."""
    one = F.col("confidence") * 2 * X.lookup(F.col("severity"), V.CHAIN_SEVERITY, 1.0) * X.lookup(F.col("kind"), V.CHAIN_MULTIPLIERS, 1.0) + F.least(F.col("n_steps") * 0.2, F.lit(1.0))
    return chains.groupBy("package_name").agg(F.count("*").alias("n_chains"), F.round(F.least(F.sum(one), F.lit(10.0)), 6).alias("threat_score"))


def supply_chain(findings: DataFrame) -> DataFrame:
    """Packages with findings of high severity and more (info counts as more), and whether there are two."""
    flagged = findings.where(X.severity_rank(F.col("severity")) >= 2).agg(F.countDistinct("package_name").alias("n_packages"))
    return flagged.withColumn("compromised", F.col("n_packages") >= 2)


def campaign_signals(findings: DataFrame) -> DataFrame:
    """Signals and categories of a package that may tell a campaign, and how much they do."""
    real = ~F.col("category").isin("unknown", "invisible_character", "homoglyph")
    counted = findings.groupBy("package_name").agg(F.count_if(real).alias("signals"), F.count_distinct(F.when(real, F.col("category"))).alias("categories"), F.count_if(real & F.col("category").isin(*V.HIGH_VALUE)).alias("high_value"))
    level = F.when((F.col("signals") < 3) | (F.col("categories") < 2), "low").when((F.col("signals") >= 5) & (F.col("categories") >= 3), "high").otherwise("medium")
    return counted.withColumn("confidence", level)


def campaign_class(findings: DataFrame, domains: DataFrame) -> DataFrame:
    """The kind of campaign that a package's categories, and the names in its ``domains`` (package_name, domain), point to.

    Delays alone point to none: they count with a domain of an assistant's tools.
    """
    has = lambda *c: F.bool_or(F.col("category").isin(*c))
    flags = findings.groupBy("package_name").agg(has("stegano_payload", "decoder_function", "invisible_character").alias("s"), has("blockchain_c2").alias("b"), has("rdd_attack").alias("r"), has("forcememo_python").alias("f"), has("time_delay_sandbox_evasion").alias("t"))
    tools = domains.where(F.col("domain").contains("mcp") | F.col("domain").contains("claude")).select("package_name", F.lit(True).alias("_m")).distinct()
    flags = flags.join(tools, "package_name", "left").withColumn("t", F.col("t") & F.coalesce("_m", F.lit(False)))
    return flags.select("package_name", F.when(F.col("s") & F.col("b"), "stego_with_chain").when(F.col("r"), "remote_dependency").when(F.col("f"), "python_loader").when(F.col("t"), "sandbox_delay").when(F.col("s"), "stego").otherwise("unknown").alias("campaign"))
