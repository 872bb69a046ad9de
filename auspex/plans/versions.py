"""The query on version policies: documents are versions of packages, one of which has a third of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from auspex.operators import policies
from auspex.plans.registered import query, table


@query(
    "sampled_versions",
    """WITH v AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id // 40 END AS p, 'v' || doc_id AS version, CASE WHEN doc_id % 11 > 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id * 37 % 400)::INT) END AS published FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY published DESC NULLS LAST, version) AS k FROM v)
SELECT 'pkg' || p AS package_name, version, published, CASE p % 6 WHEN 1 THEN 'days' WHEN 2 THEN 'all' WHEN 3 THEN 'list' ELSE 'count' END AS kind FROM r
WHERE CASE p % 6 WHEN 0 THEN k <= 3 WHEN 1 THEN published >= TIMESTAMP '2025-01-01' - INTERVAL 100 DAY WHEN 2 THEN true WHEN 3 THEN version IN ('v' || (p * 40 + 1), 'v' || (p * 40 + 7)) WHEN 4 THEN false ELSE k <= 10 END""",
)
def sampled_versions(spark, sf_dir):
    d = F.col("doc_id")
    text = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    number = F.when(d % 3 == 0, 0).otherwise(F.floor(d / 40))
    time = F.when(d % 11 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (d * 37 % 400).cast("int")).cast("timestamp"))
    versions = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(number.cast("long").alias("p"), text("pkg", number).alias("package_name"), text("v", d).alias("version"), time.alias("published"))
    p = F.col("p")
    told = F.when(p % 6 == 0, "last-3").when(p % 6 == 1, "last-100d").when(p % 6 == 2, "all").when(p % 6 == 3, F.concat(text("v", p * 40 + 1), text(", v", p * 40 + 7))).when(p % 6 == 4, "last-few")
    return policies.sampled_versions(versions.drop("p"), versions.select("package_name", told.alias("policy")), F.lit("2025-01-01").cast("timestamp"))
