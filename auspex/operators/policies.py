"""Which versions of a package are scanned, by a policy of each package.

A policy is ``all``, ``last-N`` (the newest N), ``last-Nd`` (those of N days before
``now``), or a list of versions with commas.  Rows are taken by joins and two ranks; only
packages with a ``last-N`` policy are ranked, first in SLICES parts of a package, so
that no task sorts all versions of one.

Defined cases: of equal times the least version is newer; a version without a time is the
oldest, and isn't within any days; rows that come twice, nulls in ``package_name`` or
``version``, and the registry's own entries ``created`` and ``modified`` are left out;
packages without a policy, or with a null one, get ``default``; of several policies
of one package the least counts; a policy that starts with ``last-`` but has no whole number
takes nothing, and ``faulty`` tells it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auspex.sources.shared import join_keyed

#: Parts that a package's versions are ranked in first.
SLICES = 64
#: So many versions without a policy, and in place of days if days aren't told by dates; entries that are no versions.
NEWEST, NO_VERSIONS = 10, ("created", "modified")


def kind_of(policy: Column) -> Column:
    """``all``, ``count``, ``days``, ``list`` or ``faulty``."""
    return F.when(policy == "all", "all").when(policy.rlike(r"^last-[0-9]+\z"), "count").when(policy.rlike(r"^last-[0-9]+d\z"), "days").when(policy.startswith("last-"), "faulty").otherwise("list")


def parsed(policies: DataFrame, days_by_date: bool = True) -> DataFrame:
    """package_name, kind, n, listed from package_name and policy, one a package; without ``days_by_date`` days are the newest ten."""
    each = policies.where("package_name IS NOT NULL AND policy IS NOT NULL").groupBy("package_name").agg(F.min("policy").alias("policy"))
    kind = kind_of(F.col("policy"))
    n = F.try_to_number(F.regexp_extract("policy", r"^last-([0-9]+)d?\z", 1), F.lit("9" * 18)).cast("long")
    told = each.select("package_name", kind.alias("kind"), F.when(kind.isin("count", "days"), n).alias("n"), F.when(kind == "list", F.transform(F.split("policy", ","), lambda v: F.trim(v))).alias("listed"))
    told = told.withColumn("kind", F.when(F.col("kind").isin("count", "days") & F.col("n").isNull(), "faulty").otherwise(F.col("kind")))
    if days_by_date:
        return told
    return told.withColumn("n", F.when(F.col("kind") == "days", NEWEST).otherwise(F.col("n"))).withColumn("kind", F.when(F.col("kind") == "days", "count").otherwise(F.col("kind")))


def faulty(policies: DataFrame) -> DataFrame:
    """The package_name and policy rows that can't be read."""
    found = parsed(policies).where("kind = 'faulty'").select("package_name")
    return policies.join(found, "package_name", "left_semi").select("package_name", "policy").where(F.col("policy").isNotNull())


def _newest(rows: DataFrame) -> DataFrame:
    """The ``n`` newest rows of each package."""
    order = [F.desc_nulls_last("published"), F.asc("version")]
    part = F.pmod(F.xxhash64("version"), F.lit(SLICES))
    few = rows.withColumn("_p", part).withColumn("_k", F.row_number().over(Window.partitionBy("package_name", "_p").orderBy(*order))).where("_k <= n").drop("_p", "_k")
    return few.withColumn("_k", F.row_number().over(Window.partitionBy("package_name").orderBy(*order))).where("_k <= n").drop("_k")


def sampled_versions(versions: DataFrame, policies: DataFrame, now: Column, default: int = NEWEST, days_by_date: bool = True) -> DataFrame:
    """package_name, version, published, kind of the versions (package_name, version, published) that the policies (package_name, policy) take."""
    known = versions.where("package_name IS NOT NULL AND version IS NOT NULL").where(~F.col("version").isin(*NO_VERSIONS))
    known = known.groupBy("package_name", "version").agg(F.max("published").alias("published"))
    told = parsed(policies, days_by_date).join(known.groupBy("package_name").agg(F.count("*").alias("held")), "package_name")
    rows = join_keyed(known, told, "package_name", "held", "left")
    rows = rows.withColumn("kind", F.coalesce("kind", F.lit("count"))).withColumn("n", F.when(F.col("kind") == "count", F.coalesce("n", F.lit(default))).otherwise(F.col("n")))
    since = F.unix_seconds(now.cast("timestamp")) - F.least("n", F.lit(10**9)) * 86400
    taken = rows.where((F.col("kind") == "all") | (F.col("kind") == "list") & F.array_contains("listed", F.col("version")) | (F.col("kind") == "days") & (F.unix_seconds(F.col("published").cast("timestamp")) >= since))
    return taken.unionByName(_newest(rows.where("kind = 'count'"))).select("package_name", "version", "published", "kind")
