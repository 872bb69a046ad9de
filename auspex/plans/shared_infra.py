"""Queries on infrastructure that packages share: reuse by kind, clusters by ordered merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.operators import merges
from auspex.plans.registered import query, table


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of three pages each, with the pages' hosts as domains, and wallets and authors by their numbers."""
    page = F.col("page_id")
    text = lambda prefix, number: F.concat(F.lit(prefix), number.cast("long").cast("string"))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    values = [
        F.struct(F.lit("domain").alias("kind"), host.alias("value")),
        F.struct(F.lit("wallet").alias("kind"), F.when(page % 5 == 0, text("w", F.floor(page / 40))).alias("value")),
        F.struct(F.lit("author").alias("kind"), F.when(page % 4 == 1, text("a", F.floor(page / 24))).alias("value")),
    ]
    rows = table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select(text("pkg", F.floor(page / 3)).alias("package_name"), F.explode(F.array(*values)).alias("s"))
    return rows.select("package_name", "s.kind", "s.value").where("value <> ''")


_SHARED = r"""s AS (SELECT DISTINCT 'pkg' || (page_id // 3) AS package_name, kind, value FROM (
SELECT page_id, 'domain' AS kind, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS value FROM pages
UNION ALL SELECT page_id, 'wallet', 'w' || (page_id // 40) FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, 'author', 'a' || (page_id // 24) FROM pages WHERE page_id % 4 = 1) WHERE value <> '')"""


@query("infra_reuse_kinds", f"WITH {_SHARED} SELECT kind, count(*) AS n_values, count(*) FILTER (n > 1) AS n_reused, round(avg(n), 6) AS avg_packages FROM (SELECT kind, value, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1")
def infra_reuse_kinds(spark, sf_dir):
    return merges.reuse(shared(spark, sf_dir))


@query(
    "infra_merges",
    f"""WITH RECURSIVE {_SHARED}, v AS (SELECT kind, value, row_number() OVER (ORDER BY list_position(['domain', 'wallet', 'author'], kind), value) AS v FROM (SELECT kind, value FROM s GROUP BY ALL HAVING count(*) > 1)),
h AS (SELECT package_name, v FROM s JOIN v USING (kind, value)), e AS (SELECT DISTINCT v, u FROM (SELECT v, lag(v) OVER (PARTITION BY package_name ORDER BY v) AS u FROM h) WHERE u IS NOT NULL),
r AS (SELECT v, v AS c FROM v UNION SELECT r.v, e.u FROM r JOIN e ON r.c = e.v), f AS (SELECT v, min(c) AS c FROM r GROUP BY 1)
SELECT n.kind || ':' || n.value AS cluster, package_name, count(*) AS n_values FROM h JOIN f USING (v) JOIN v n ON n.v = f.c GROUP BY ALL""",
)
def infra_merges(spark, sf_dir):
    return merges.ordered_clusters(shared(spark, sf_dir))
