"""Queries on runs of hidden code points, blobs of high entropy, and places of manifest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.operators import payload, runs
from auspex.plans.registered import query, table
from auspex.sources import manifests

#: Bytes hidden in every document, by its number: text, text twice in a line, apart by a line end, no UTF-8, too few.
_RUNS = 5


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first and last bytes of its own digest, in hexadecimal, hidden behind it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.md5("text")
    marks = F.struct(payload.selectors(F.encode(digest, "UTF-8")).alias("marks"), payload.selectors(F.unhex(F.concat(F.lit("ff"), digest))).alias("none_utf8"))
    docs = docs.select("doc_id", "text", F.inline(F.array(marks)))
    hidden = lambda a, n: F.substring("marks", a, n)  # noqa: E731  a selector for each byte
    kind = F.col("doc_id") % _RUNS
    tail = (
        F.when(kind == 0, F.concat(F.lit("é "), hidden(1, 32)))
        .when(kind == 1, F.concat(F.lit("a"), hidden(1, 16), F.lit("bc"), hidden(17, 16)))
        .when(kind == 2, F.concat(hidden(1, 20), F.lit("\n"), hidden(21, 8), F.lit("\n  x"), hidden(1, 17)))
        .when(kind == 3, F.concat(F.lit("= "), F.col("none_utf8")))
        .otherwise(F.concat(hidden(1, 15), F.lit("-"), hidden(17, 15)))
    )
    return docs.select(F.lit("app").alias("package_name"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), F.concat("text", F.lit("\n"), tail).alias("content"))


_FOUND = """SELECT doc_id, 2 AS down, 3 AS col, d AS hidden FROM m WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 2, 2, d[1:16] FROM m WHERE doc_id % 5 = 1 UNION ALL SELECT doc_id, 2, 20, d[17:32] FROM m WHERE doc_id % 5 = 1
  UNION ALL SELECT doc_id, 2, 1, d[1:20] FROM m WHERE doc_id % 5 = 2 UNION ALL SELECT doc_id, 4, 4, d[1:17] FROM m WHERE doc_id % 5 = 2"""


@query(
    "hidden_runs",
    f"""WITH m AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS d FROM documents),
r AS (SELECT doc_id, down, col, hidden AS decoded, regexp_extract_all(hex(encode(hidden)), '..') AS bytes FROM ({_FOUND}) UNION ALL SELECT doc_id, 2, 3, NULL, list_concat(['FF'], regexp_extract_all(upper(d), '..')) FROM m WHERE doc_id % 5 = 3),
c AS (SELECT doc_id, down, col, b, count(*) AS n FROM (SELECT doc_id, down, col, unnest(bytes) AS b FROM r) GROUP BY ALL),
e AS (SELECT doc_id, down, col, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM c GROUP BY ALL)
SELECT 'app' AS package_name, 'f' || doc_id AS file_path, length(text) - length(replace(text, chr(10), '')) + down AS line, col::BIGINT AS col, len(bytes) AS n_points, len(bytes) AS n_bytes, round(entropy, 6) AS entropy,
  CASE WHEN entropy > 7 THEN 'encrypted' WHEN entropy >= 6 OR decoded IS NULL THEN 'suspicious' ELSE 'plaintext' END AS payload_class, decoded, CASE WHEN decoded IS NULL THEN 'high' ELSE 'critical' END AS severity
FROM r JOIN e USING (doc_id, down, col) JOIN m USING (doc_id)""",
)
def hidden_runs(spark, sf_dir):
    return runs.hidden_runs(run_files(spark, sf_dir))


_DECRYPT = "eval(createDecipheriv(k))"


def blob_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a blob made of its digests behind it: in base64, in literals that break it up, of low entropy, a byte too short, without execution, in a built file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    code = F.concat(F.base64(F.unhex(F.sha2("text", 256))), F.base64(F.unhex(F.sha2(F.concat("text", F.lit("x")), 256))))
    part = lambda a, n: F.substring(code, a, n)
    kind = F.col("doc_id") % 8
    line = (
        F.when(kind.isin(0, 6, 7), F.concat(F.lit("let a = '"), code, F.lit("'")))
        .when(kind == 1, F.concat(F.lit('let a = "'), part(1, 40), F.lit("-"), part(41, 40), F.lit('"')))
        .when(kind == 2, F.concat(F.lit("let a = `"), part(1, 32), F.lit("-"), part(41, 31), F.lit("`")))
        .when(kind == 3, F.concat(F.lit("let a = '"), part(1, 31), F.lit("-"), part(41, 31), F.lit("'")))
        .when(kind == 4, F.concat(F.lit("let a = '"), F.repeat(F.lit("ab-"), 30), F.lit("'")))
        .otherwise(F.concat(F.lit("let a = "), F.sha2("text", 256), F.lit("\nlet b = '"), code, F.lit("'")))
    )
    path = F.concat(F.when(kind == 7, "dist/f").otherwise("src/f"), F.col("doc_id").cast("string"), F.lit(".js"))
    # lines of at most 100 characters, so no text makes its file a minified one
    text = F.regexp_replace("text", r"([^\n]{100})", "$1\n")
    return docs.select(F.lit("app").alias("package_name"), path.alias("file_path"), F.concat(text, F.lit("\n"), line, F.when(kind == 6, "").otherwise(F.lit("\n" + _DECRYPT))).alias("content"))


@query(
    "encrypted_payloads",
    f"""WITH w AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([^\\n]{{100}})', '\\1' || chr(10), 'g') AS text, to_base64(unhex(sha256(coalesce(text, '')))) || to_base64(unhex(sha256(coalesce(text, '') || 'x'))) AS code FROM documents),
b AS (SELECT doc_id, text, CASE doc_id % 8 WHEN 1 THEN code[1:40] || '-' || code[41:80] WHEN 2 THEN code[1:32] || '-' || code[41:71] ELSE code END AS blob FROM w WHERE doc_id % 8 IN (0, 1, 2, 5)),
c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(blob, '')) AS ch FROM b) GROUP BY ALL),
e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM c GROUP BY 1)
SELECT 'app' AS package_name, 'src/f' || doc_id || '.js' AS file_path, length(text) - length(replace(text, chr(10), '')) + 2 AS line, round(entropy, 6) AS entropy FROM b JOIN e USING (doc_id) WHERE entropy > {runs.ENTROPY}""",
)
def encrypted_payloads(spark, sf_dir):
    return runs.encrypted_payloads(blob_files(spark, sf_dir))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of some lines for each document; others are broken, or no manifest by their name."""
    d = F.col("doc_id")
    content = F.concat(
        F.repeat(F.lit("\n"), (d % 4).cast("int")),
        F.lit('{\n  "é": "name", "author": '), F.when(d % 3 == 0, '{"name": "JPD"}').otherwise('"x"'), F.lit(',\n  "dependencies": {\n    "a": "^1.0.0", "b": "'),
        F.when(d % 2 == 0, F.concat(F.lit("https://h.example/"), d.cast("string"))).otherwise("~2"), F.lit('"},\n  "devDependencies": {"c": "http://storeartifact.example"}\n'),
        F.when(d % 5 == 4, "").otherwise("}"),
    )
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), d.cast("string")).alias("package_name"), F.when(d % 7 == 6, "package-lock.json").otherwise("lib/package.json").alias("file_path"), content.alias("content"))


_MANIFEST = "FROM documents WHERE doc_id % 5 <> 4 AND doc_id % 7 <> 6"


@query(
    "manifest_findings",
    f"""SELECT 'p' || doc_id AS package_name, 'lib/package.json' AS file_path, (doc_id % 4 + line)::BIGINT AS line, col::BIGINT AS col, 0::BIGINT AS code_point, 'rdd_attack' AS category, severity, description, NULL::DOUBLE AS confidence FROM (
  SELECT doc_id, 2 AS line, 27 AS col, 'critical' AS severity, 'author of a known campaign' AS description {_MANIFEST} AND doc_id % 3 = 0
  UNION ALL SELECT doc_id, 4, 20, 'high', 'dependency from a URL' {_MANIFEST} AND doc_id % 2 = 0
  UNION ALL SELECT doc_id, 5, 23, 'critical', 'dependency from a URL' {_MANIFEST})""",
)
def manifest_findings(spark, sf_dir):
    return manifests.manifest_findings(manifest_files(spark, sf_dir))


#: Lines of a stream cipher, each of one kind; a document has those of the bits of its number.
_CIPHER = ("for (i = 0; i < 256; i++) s[i] = i", "o = a ^ b", "j = (j + 1) % 256", "tmp = s[i]; s[i] = s[j]; s[j] = tmp", "c = x.charCodeAt(0)")


def cipher_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("doc_id")
    lines = F.concat_ws("\n", F.when(d % 3 > 0, "eval(x)"), *(F.when(d.bitwiseAND(1 << k) > 0, line) for k, line in enumerate(_CIPHER)))
    text = F.translate("text", "^&%", "")
    return docs.select(F.lit("app").alias("package_name"), F.concat(F.when(d % 7 == 0, "test/f").otherwise("src/f"), d.cast("string"), F.lit(".js")).alias("file_path"), F.concat(text, F.lit("\n"), lines).alias("content"))


_BITS = " + ".join(f"(doc_id // {1 << k}) % 2" for k in range(len(_CIPHER)))
_KINDS = "concat_ws(',', " + ", ".join(f"CASE WHEN (doc_id // {1 << k}) % 2 = 1 THEN '{kind}' END" for k, kind in enumerate(runs.CIPHER_SIGNS)) + ")"


@query("stream_ciphers", f"SELECT 'app' AS package_name, 'src/f' || doc_id || '.js' AS file_path, length(text) - length(replace(text, chr(10), '')) + 2 AS line, {_KINDS} AS kinds, CASE {_BITS} WHEN 3 THEN 0.5 WHEN 4 THEN 0.7 ELSE 0.85 END::DOUBLE AS confidence FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE doc_id % 3 > 0 AND doc_id % 7 > 0 AND {_BITS} >= 3")
def stream_ciphers(spark, sf_dir):
    return runs.stream_ciphers(cipher_files(spark, sf_dir))
