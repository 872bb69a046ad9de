"""Queries on the selection of packages and on totals of scans; business tables stand for registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auspex.operators import detect, selection, state
from auspex.plans import catalog
from auspex.plans.registered import QUERIES, query, table
from auspex.sources import corpus
from auspex.streaming import progress

KEYWORDS = {"cheap": ("ECONOMY", "PROMO"), "middle": ("MEDIUM", "STANDARD"), "small": ("SMALL",)}


@query("category_sample", "SELECT category, name FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY name) AS rn FROM (SELECT DISTINCT k.category, upper(p_type) || ' ' || p_brand AS name FROM part, (VALUES ('cheap', 'ECONOMY'), ('cheap', 'PROMO'), ('middle', 'MEDIUM'), ('middle', 'STANDARD'), ('small', 'SMALL')) AS k(category, word) WHERE contains(upper(p_type) || ' ' || p_brand, word))) WHERE rn <= 20")
def category_sample(spark, sf_dir):
    """A sampling operator: 20 names a category."""
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", F.upper("p_type"), "p_brand").alias("name"))
    return selection.by_keywords(names, KEYWORDS, 20).select("category", "name")


@query("wave_packages", "SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT s_name FROM supplier) WHERE NOT contains(name, '7') AND NOT contains(name, 'Supplier#000000001')")
def wave_packages(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    listed, found = customers.where("c_custkey % 10 = 0"), customers.where("c_mktsegment = 'BUILDING'")
    return selection.wave([listed.select(F.col("c_name").alias("name")), found.select(F.col("c_name").alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))], ("7", "Supplier#000000001"))


@query("risky_new_packages", "SELECT CASE WHEN c_custkey % 7 = 0 THEN '@s/' ELSE '' END || c_name AS name, max(o_orderdate) AS published FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 3 = 0 AND c_acctbal < 1000 AND c_custkey % 7 > 0 GROUP BY ALL HAVING max(o_orderdate) >= (SELECT max(o_orderdate) - INTERVAL 300 DAY FROM orders)")
def risky_new_packages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("published"))
    k = F.col("c_custkey")
    packages = table(spark, sf_dir, "customer").join(last, "c_custkey").select(F.concat(F.when(k % 7 == 0, "@s/").otherwise(""), "c_name").alias("name"), "published", (k % 3 == 0).alias("has_scripts"), F.col("c_acctbal").alias("downloads"))
    now = orders.agg(F.max("o_orderdate")).first()[0]
    return selection.risky_new(packages, F.lit(now), days=300).select("name", "published")


@query("capped_by_category", "SELECT c_nationkey, c_name, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS rn FROM customer WHERE c_acctbal >= 500) WHERE rn <= 5")
def capped_by_category(spark, sf_dir):
    """A sampling operator: five packages a category."""
    return selection.capped(table(spark, sf_dir, "customer"), "c_nationkey", [F.col("c_acctbal").desc(), F.col("c_name")], 5, 500, "c_acctbal").select("c_nationkey", "c_name", "c_acctbal")


@query("rescanned_packages", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def rescanned_packages(spark, sf_dir):
    """What a run flagged is scanned again: a semi-join."""
    flagged = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(flagged, "c_custkey", "left_semi")


@query("review_files", f"WITH {catalog.duck.FILES} SELECT package_name, file_path, content FROM (SELECT package_name, file_path, substr(content, 1, 5000) AS content, row_number() OVER (PARTITION BY package_name ORDER BY file_path) AS rn FROM corpus WHERE suffix(file_path, '.js')) WHERE rn <= 50")
def review_files(spark, sf_dir):
    """A sampling operator: up to 50 files a package."""
    return selection.review_files(corpus.files(spark, sf_dir))


@query("scanned_recently", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 < 2")
def scanned_recently(spark, sf_dir):
    """Of three parts one was scanned as it is; of four scans two are recent."""
    k = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), k.alias("version"), F.sha2("p_name", 256).alias("sha256"))
    scans = items.select("name", "version", F.when(k % 3 == 0, F.col("sha256")).otherwise("other").alias("sha256"), F.when(k % 4 < 2, F.lit("2024-01-09")).otherwise(F.lit("2024-01-02")).cast("timestamp").alias("scanned_at"))
    return selection.scanned_recently(items, scans, F.lit("2024-01-03").cast("timestamp")).select("p_partkey")


@query("cache_stats", "SELECT count(*) FILTER (k = 3) AS hits, count(*) FILTER (k IN (0, 2)) AS misses, count(*) FILTER (k = 1) AS expired, round(100.0 * count(*) FILTER (k = 3) / count(*), 6) AS hit_rate FROM (SELECT o_orderkey % 4 AS k FROM orders)")
def cache_stats(spark, sf_dir):
    return selection.cache_stats(QUERIES["cache_lookup"](spark, sf_dir))


@query("registry_stats", "SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, count(*) AS n, CASE WHEN status = 'completed' THEN round(sum(o_totalprice), 2) END AS total FROM orders GROUP BY 1")
def registry_stats(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return selection.registry_stats(table(spark, sf_dir, "orders").select(status.alias("status"), F.col("o_totalprice").alias("value")))


@query("scan_history", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def scan_history(spark, sf_dir):
    """A top-k report: the last 50 completed scans."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return done.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query("campaign_totals", "SELECT count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (event_type = 'purchase') AS n_flagged FROM events")
def campaign_totals(spark, sf_dir):
    """Sums over the waves' counters."""
    waves = progress.counters(table(spark, sf_dir, "events"))
    return waves.agg(*(F.sum(c).cast("long").alias(c) for c in ("n_events", "n_errors", "n_flagged")))


@query("version_progress", "SELECT o_custkey, count(*) AS n_versions, count(*) FILTER (o_orderstatus = 'P') AS n_failed, round(100.0 * count(*) FILTER (o_orderstatus <> 'O') / count(*), 6) AS percent FROM orders GROUP BY 1")
def version_progress(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_versions"), F.count_if(status == "P").alias("n_failed"), F.round(100.0 * F.count_if(status != "O") / F.count("*"), 6).alias("percent"))


_COUNTS = "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_malicious, count(*) FILTER (event_type = 'error') AS n_suspicious, count(*) FILTER (event_type IN ('click', 'view')) AS n_false, count(*) AS n_total FROM events GROUP BY 1"


@query(
    "overall_classes",
    f"""WITH c AS ({_COUNTS}), k AS (SELECT *, CASE WHEN n_malicious / n_total > 0.5 THEN 'MALICIOUS' WHEN n_malicious / n_total > 0.2 OR n_suspicious / n_total > 0.5 THEN 'SUSPICIOUS' WHEN n_false / n_total > 0.8 THEN 'FALSE_POSITIVE' ELSE 'NEEDS_REVIEW' END AS classification FROM c)
SELECT *, CASE classification WHEN 'MALICIOUS' THEN CASE WHEN n_malicious / n_total > 0.7 THEN 'CONFIRMED' ELSE 'HIGH_CONFIDENCE' END WHEN 'SUSPICIOUS' THEN 'NEEDS_VERIFICATION' WHEN 'FALSE_POSITIVE' THEN 'LIKELY_CLEAN' ELSE 'UNCLASSIFIED' END AS tier,
CASE classification WHEN 'MALICIOUS' THEN CASE WHEN n_malicious >= 3 THEN 'REPORT_IMMEDIATELY' ELSE 'REPORT' END WHEN 'SUSPICIOUS' THEN 'INVESTIGATE' WHEN 'FALSE_POSITIVE' THEN 'IGNORE' ELSE 'REVIEW' END AS recommendation FROM k""",
)
def overall_classes(spark, sf_dir):
    of = lambda *types: F.count_if(F.col("event_type").isin(*types))
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(of("purchase").alias("n_malicious"), of("error").alias("n_suspicious"), of("click", "view").alias("n_false"), F.count("*").alias("n_total"))
    return selection.overall(counts)


@query("first_findings", f"{catalog.UNIQUE} SELECT package_name, file_path, line, col, category, severity FROM (SELECT *, row_number() OVER (PARTITION BY package_name ORDER BY list_position(['critical', 'high', 'medium', 'low', 'info'], severity), file_path, line, col, category) AS rn FROM uniq) WHERE rn <= 10")
def first_findings(spark, sf_dir):
    """A report: ten findings a package."""
    return selection.first_findings(detect.corpus_unique(spark, sf_dir)).select("package_name", "file_path", "line", "col", "category", "severity")
