"""Package manifests: remote dependencies and known authors.

The driver's tables have no manifests; each document gets a made-up one by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.operators.positions import place_of
from auspex.operators.rows import KEY, finding, rows_of

#: Parts of the hosts that remote dependencies of known campaigns had.
KNOWN_DOMAINS = ("storeartifact", "jpartifacts", "artifactsnpm", "npm.pkg-registry")
AUTHORS = ("JPD", "jpd", "Jpd")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package_name, file_path, doc (a variant)."""
    d = F.col("doc_id")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    author = F.when(d % 7 == 0, '{"name": "JPD"}').when(d % 7 == 1, '"jpd"').otherwise('"someone"')
    remote = F.when(d % 5 == 0, text(', "b": "http://x.example/', d.cast("string"), '.tgz"')).when(d % 5 == 1, ', "c": "https://storeartifact.example/c"').otherwise("")
    # one in 11 has a remote development dependency, one in 13 a known maintainer
    more = F.concat(F.when(d % 11 == 0, ', "devDependencies": {"e": "https://y.example/e.tgz", "f": "~2.0"}').otherwise(""), F.when(d % 13 == 0, ', "maintainers": [{"name": "Jpd"}, {"name": "other"}]').otherwise(""))
    doc = text('{"author": ', author, ', "dependencies": {"a": "^1.0.0"', remote, "}", more, "}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return docs.select(F.concat(F.lit("pkg"), d.cast("string")).alias("package_name"), F.lit("package.json").alias("file_path"), F.try_parse_json(doc).alias("doc"))


SQL = """manifest AS (SELECT 'pkg' || doc_id AS package_name, 'package.json' AS file_path, ('{"author": ' || CASE WHEN doc_id % 7 = 0 THEN '{"name": "JPD"}' WHEN doc_id % 7 = 1 THEN '"jpd"' ELSE '"someone"' END
  || ', "dependencies": {"a": "^1.0.0"' || CASE WHEN doc_id % 5 = 0 THEN ', "b": "http://x.example/' || doc_id || '.tgz"' WHEN doc_id % 5 = 1 THEN ', "c": "https://storeartifact.example/c"' ELSE '' END || '}' || CASE WHEN doc_id % 11 = 0 THEN ', "devDependencies": {"e": "https://y.example/e.tgz", "f": "~2.0"}' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN ', "maintainers": [{"name": "Jpd"}, {"name": "other"}]' ELSE '' END || '}')::JSON AS doc FROM documents)"""


def url_dependencies(found: DataFrame) -> DataFrame:
    """Dependencies, those for development too, that name a URL; known hosts are critical."""
    entries = lambda path: F.map_entries(F.coalesce(F.try_variant_get("doc", path, "map<string,string>"), F.create_map().cast("map<string,string>")))
    each = found.select("package_name", "file_path", F.explode(F.concat(entries("$.dependencies"), entries("$.devDependencies"))).alias("e")).select("package_name", "file_path", F.col("e.key").alias("dep"), F.col("e.value").alias("url"))
    severity = F.when(F.col("url").rlike("|".join(d.replace(".", r"\.") for d in KNOWN_DOMAINS)), "critical").otherwise("high")
    return each.where(F.col("url").rlike("^https?://")).withColumn("severity", severity)


def known_authors(found: DataFrame) -> DataFrame:
    """Manifests whose author, by name or as a text, or first maintainer is a known one; the first of these that is counts."""
    named = [F.try_variant_get("doc", path, "string") for path in ("$.author.name", "$.author", "$.maintainers[0].name")]
    author = F.coalesce(*(F.when(x.isin(*AUTHORS), x) for x in named))
    return found.select("package_name", "file_path", author.alias("author")).where("author IS NOT NULL")


def manifest_findings(files: DataFrame) -> DataFrame:
    """FINDING of each remote dependency and each known author of the manifests among ``files`` (package_name, file_path, content), at the line and column of its member.

    The place is that of the member as it is mostly written, ``"key": "value"``, else
    the manifest's first line.  Files of other names and broken manifests have none.
    """
    own = files.where(F.regexp_extract("file_path", r"([^/]*)$", 1) == "package.json").select(*KEY, "content", F.try_parse_json("content").alias("doc"))
    texts = own.select(*KEY, "content").distinct()
    quoted = lambda key, value: F.concat(F.lit('"'), key, F.lit('": "'), value, F.lit('"'))
    members = url_dependencies(own).select(*KEY, quoted(F.col("dep"), F.col("url")).alias("member"), "severity", F.lit("dependency from a URL").alias("what"))
    authors = known_authors(own).select(*KEY, quoted(F.lit("name"), F.col("author")).alias("member"), F.lit("critical").alias("severity"), F.lit("author of a known campaign").alias("what"))
    placed = members.unionByName(authors).distinct().join(texts, list(KEY)).withColumn("_at", place_of(F.col("content"), F.col("member")))
    found = []
    for what in ("dependency from a URL", "author of a known campaign"):
        f = finding(F.coalesce("_at.line", F.lit(1)), "rdd_attack", F.col("severity"), what, col=F.coalesce("_at.col", F.lit(1)))
        found.append(rows_of(placed.where(F.col("what") == what).withColumn("f", f)))
    return found[0].unionByName(found[1])
