"""Queries on packages in archives, which Spark writes from the documents first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.plans.registered import query, table
from auspex.sources import archives
from auspex.sources.shared import new_path, once, remove

#: Documents in an archive, by their numbers.
EACH = 50


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, plain, member, content: five kinds of archives in turn.

    With a package folder and files beside it; uncompressed, named by its manifest only;
    without a package folder; not compressed although its name says so; with long paths.
    """
    d = F.col("doc_id")
    k = F.floor(d / EACH)
    kind, number = k % 5, k.cast("string")
    name = (
        F.when(kind == 0, F.concat(F.lit("p"), number, F.lit("-1."), (k % 3).cast("string"), F.lit(".0.tgz")))
        .when(kind == 1, F.concat(F.lit("lib"), number, F.lit(".tar")))
        .when(kind == 2, F.concat(F.lit("@s-q"), number, F.lit("-0.1.0.tar.gz")))
        .when(kind == 3, F.concat(F.lit("bad"), number, F.lit("-1.0.0.tgz")))
        .otherwise(F.concat(F.lit("big"), number, F.lit(".tar")))
    )
    root = F.when((kind == 0) & (d % 8 == 0), "other/").when(kind == 2, "").when(kind == 4, F.concat(F.lit("package/"), F.repeat(F.lit("n"), 120), F.lit("/"))).otherwise("package/")
    doc = d.cast("string")
    tail = (
        F.when(d % 4 == 0, F.concat(F.lit("src/m"), doc, F.lit(".js")))
        .when(d % 4 == 1, F.concat(F.lit("dist/m"), doc, F.lit(".min.js")))
        .when(d % 4 == 2, F.concat(F.lit("node_modules/d/m"), doc, F.lit(".js")))
        .otherwise(F.concat(F.lit("m"), doc, F.lit(".bin")))
    )
    docs = table(spark, sf_dir, "documents")
    plain = kind.isin(1, 3, 4)
    files = docs.select(name.alias("archive"), plain.alias("plain"), F.concat(root, tail).alias("member"), F.coalesce("text", F.lit("")).alias("content"))
    manifest = F.concat(F.lit('{"name": "lib-'), number, F.lit('", "version": "2.0.0"}'))
    named = docs.where(kind == 1).select(name.alias("archive"), plain.alias("plain"), F.lit("package/package.json").alias("member"), manifest.alias("content")).distinct()
    return files.unionByName(named)


def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        path = new_path(spark, "archives")
        archives.write_archives(archive_members(spark, sf_dir), path)
        folders.append(path)
        return archives.read_archives(spark, path)

    folders: list[str] = []
    found = once(spark, "archive_files", f"{sf_dir}/documents.parquet", make)
    for path in folders:  # all is in the table
        remove(spark, path)
    return found.withColumn("archive", F.regexp_extract("archive", "([^/]+)$", 1))


@query(
    "archive_files",
    f"""WITH d AS (SELECT doc_id, doc_id // {EACH} AS k, coalesce(text, '') AS text FROM documents),
m AS (SELECT *, k % 5 AS kind, bool_or(doc_id % 8 > 0) OVER (PARTITION BY k) AS inner_, CASE doc_id % 4 WHEN 0 THEN 'src/m' || doc_id || '.js' ELSE 'dist/m' || doc_id || '.min.js' END AS tail FROM d),
f AS (SELECT k, kind, CASE WHEN kind = 4 THEN repeat('n', 120) || '/' || tail WHEN kind = 0 AND doc_id % 8 = 0 THEN 'other/' || tail ELSE tail END AS file_path, text FROM m WHERE doc_id % 4 < 2 AND kind <> 3 AND NOT (kind = 0 AND doc_id % 8 = 0 AND inner_)
  UNION ALL SELECT k, kind, 'package.json', '{{"name": "lib-' || k || '", "version": "2.0.0"}}' FROM (SELECT DISTINCT k, kind FROM m WHERE kind = 1))
SELECT CASE kind WHEN 0 THEN 'p' || k || '-1.' || k % 3 || '.0.tgz' WHEN 1 THEN 'lib' || k || '.tar' WHEN 2 THEN '@s-q' || k || '-0.1.0.tar.gz' ELSE 'big' || k || '.tar' END AS archive,
  CASE kind WHEN 0 THEN 'p' || k WHEN 1 THEN 'lib-' || k WHEN 2 THEN '@s-q' || k ELSE 'big' || k END AS package_name, CASE kind WHEN 0 THEN '1.' || k % 3 || '.0' WHEN 1 THEN '2.0.0' WHEN 2 THEN '0.1.0' ELSE 'unknown' END AS version,
  file_path, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM f""",
)
def archive_files(spark, sf_dir):
    """The files of whole archives that the walk takes."""
    found = read_back(spark, sf_dir).where("error is null")
    return found.select("archive", "package_name", "version", "file_path", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"))


@query("broken_archives", f"SELECT DISTINCT 'bad' || doc_id // {EACH} || '-1.0.0.tgz' AS archive, 'bad' || doc_id // {EACH} AS package_name, '1.0.0' AS version, 'unreadable' AS error FROM documents WHERE doc_id // {EACH} % 5 = 3")
def broken_archives(spark, sf_dir):
    """Archives of which nothing is read."""
    return read_back(spark, sf_dir).where("error is not null and file_path is null").select("archive", "package_name", "version", "error")
