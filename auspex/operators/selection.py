"""Which packages and files to look at, and totals of what was looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.operators.state import latest

#: Files that a review reads first, and how much of them and of others.
FIRST_FILES, FIRST_CHARS, OTHER_CHARS, MOST_FILES = ("package.json", "install.js", "preinstall.js", "postinstall.js", "index.js"), 10_000, 5_000, 50


def by_keywords(names: DataFrame, keywords: dict[str, tuple[str, ...]], n: int) -> DataFrame:
    """category, name: the first ``n`` names of each category, one of whose words a name has."""
    fits = F.array_compact(F.array(*(F.when(X.contains_any(F.col("name"), words), F.lit(c)) for c, words in keywords.items())))
    return latest(names.select("name", F.explode(fits).alias("category")).distinct(), ["category"], [F.col("name")], n)


def wave(sources: list[DataFrame], allowed: tuple[str, ...]) -> DataFrame:
    """The distinct names of all sources that have no part in ``allowed``."""
    names = sources[0].select("name")
    for source in sources[1:]:
        names = names.unionByName(source.select("name"))
    return names.where(~X.contains_any(F.col("name"), allowed)).distinct()


def risky_new(packages: DataFrame, now: Column, days: int = 30, downloads: int = 1000) -> DataFrame:
    """Packages (name, published, has_scripts, downloads) that are recent, run a script on install, are little used and have no scope."""
    return packages.where((F.col("published") >= now - F.expr(f"INTERVAL {days} DAYS")) & F.col("has_scripts") & (F.col("downloads") < downloads) & ~F.col("name").startswith("@"))


def capped(packages: DataFrame, by: str, order: list[Column], n: int, least: float, measure: str) -> DataFrame:
    """The first ``n`` of each group of those with ``least`` of a measure."""
    return latest(packages.where(F.col(measure) >= least), [by], order, n)


def review_files(files: DataFrame) -> DataFrame:
    """package_name, file_path, content: what a review of a package reads, some files first, then scripts, cut to a length."""
    base = F.regexp_extract("file_path", r"([^/]+)$", 1)
    place = F.array_position(F.array(*map(F.lit, FIRST_FILES)), base)
    wanted = files.withColumn("_p", F.when(place > 0, place).otherwise(99)).where((F.col("_p") < 99) | (base.endswith(".js") & ~base.startswith(".") & ~F.col("file_path").contains("node_modules")))
    kept = latest(wanted, ["package_name"], [F.col("_p"), F.col("file_path")], MOST_FILES)
    return kept.select("package_name", "file_path", F.substring("content", F.lit(1), F.when(F.col("_p") < 99, FIRST_CHARS).otherwise(OTHER_CHARS)).alias("content"))


def scanned_recently(items: DataFrame, scans: DataFrame, since: Column) -> DataFrame:
    """``items`` (name, version, sha256) that were scanned as they are after ``since``."""
    return items.join(scans.where(F.col("scanned_at") > since), ["name", "version", "sha256"], "left_semi")


def cache_stats(looked_up: DataFrame) -> DataFrame:
    """Hits, misses, stale entries and the rate of hits in percent of ``state.cache_lookup``'s rows."""
    n = {k: F.count_if(F.col("state") == s) for k, s in (("hits", "hit"), ("misses", "miss"), ("expired", "stale"))}
    return looked_up.agg(*(c.alias(k) for k, c in n.items()), F.round(F.try_divide(100.0 * n["hits"], F.count("*")), 6).alias("hit_rate"))


def registry_stats(scans: DataFrame) -> DataFrame:
    """Scans (status, value) by status, with the sum of the values of completed ones."""
    return scans.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("status") == "completed", F.col("value"))), 2).alias("total"))


def overall(counts: DataFrame) -> DataFrame:
    """Class, tier and recommendation of packages with n_malicious, n_suspicious, n_false and n_total findings."""
    share = lambda c: F.try_divide(F.col(c), F.col("n_total"))
    kind = F.when(F.col("n_total") == 0, "CLEAN").when(share("n_malicious") > 0.5, "MALICIOUS").when((share("n_malicious") > 0.2) | (share("n_suspicious") > 0.5), "SUSPICIOUS").when(share("n_false") > 0.8, "FALSE_POSITIVE").otherwise("NEEDS_REVIEW")
    is_ = lambda k: F.col("classification") == k
    tier = F.when(is_("MALICIOUS") & (share("n_malicious") > 0.7), "CONFIRMED").when(is_("MALICIOUS"), "HIGH_CONFIDENCE").when(is_("SUSPICIOUS"), "NEEDS_VERIFICATION").when(is_("FALSE_POSITIVE"), "LIKELY_CLEAN").otherwise("UNCLASSIFIED")
    action = F.when(is_("MALICIOUS") & (F.col("n_malicious") >= 3), "REPORT_IMMEDIATELY").when(is_("MALICIOUS"), "REPORT").when(is_("SUSPICIOUS"), "INVESTIGATE").when(is_("FALSE_POSITIVE"), "IGNORE").otherwise("REVIEW")
    return counts.withColumn("classification", kind).withColumn("tier", tier).withColumn("recommendation", action)


def first_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` findings of each package, the gravest first, then by place."""
    order = [F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.col("severity")), F.col("file_path"), F.col("line"), F.col("col"), F.col("category")]
    return latest(findings, ["package_name"], order, n)
