"""Findings that other layers bear out: files on disk, browser extensions, binaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories of rules on binaries.
BINARY = ("xorshift_obfuscation", "ielevator_com", "apc_injection", "memexec_loader")


def enriched(findings: DataFrame, context: DataFrame, is_exfil: Column | None = None) -> DataFrame:
    """``findings`` with ``correlations`` (empty for none) and the confidence that they raise: by 0.1 up to 0.95 below 0.9, null becomes 0.75.

    ``context``: kind (filesystem, chrome, binary, js), file_path, severity, context.
    What holds for a file comes from a join on it; what holds for all findings is one row of flags.
    """
    exfil = F.col("category") == "exfil_schema" if is_exfil is None else is_exfil
    kind, said = F.col("kind"), F.coalesce("context", F.lit(""))
    anywhere = context.agg(
        F.bool_or((kind == "filesystem") & F.col("file_path").endswith(".node")).alias("node"),
        F.bool_or((kind == "filesystem") & said.contains("extension")).alias("extension"),
        F.bool_or((kind == "chrome") & (F.col("severity") == "critical")).alias("chrome"),
        F.bool_or((kind == "chrome") & (said.contains("permissions") | said.contains("nativeMessaging"))).alias("permissions"),
    ).first()
    given = lambda name: F.lit(bool(anywhere[name]))
    layers = ("filesystem", "binary", "js")
    by_file = context.where(kind.isin(*layers)).groupBy(F.col("file_path").alias("_file")).agg(*(F.bool_or(kind == k).alias(f"_{k}") for k in layers))
    joined = findings.join(by_file, F.col("file_path") == F.col("_file"), "left")
    here = {k: F.coalesce(F.col(f"_{k}"), F.lit(False)) for k in layers}
    told = F.concat_ws(
        ", ",
        F.when(here["filesystem"] | (F.col("category").isin(*BINARY) & given("node")) | (exfil & given("extension")), "filesystem artifact found"),
        F.when(given("chrome") | (exfil & given("permissions")), "Chrome extension correlation"),
        F.when(here["binary"], "binary payload correlation"),
        F.when(here["js"] & here["binary"], "JS+binary multi-layer detection"),
    )
    c = F.col("confidence")
    raised = F.when(F.col("correlations") == "", c).when(c.isNull(), 0.75).when(c < 0.9, F.least(c + 0.1, F.lit(0.95))).otherwise(c)
    return joined.withColumn("correlations", told).withColumn("confidence", raised).select(*findings.columns, "correlations")
