"""Runs of hidden code points, each decoded, and string literals of high entropy next to decryption and execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V
from auspex.operators import gates
from auspex.operators.payload import hidden_bytes, payload_class
from auspex.operators.positions import line_ends, statements
from auspex.operators.rows import KEY, finding, rows_of

# The least length of a run, of a blob in bytes, and the entropy above which a blob counts.
RUN = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]{16,}"
BLOB_BYTES, ENTROPY = 64, 4.5
#: Quoted literals and template literals of a line.
QUOTED, TEMPLATE = r"\"([^\"]{64,})\"|'([^']{64,})'", r"`([^`]{64,})`"
HEX_RUN, BASE64_RUN = r"[0-9a-fA-F]{64,}", r"[A-Za-z0-9+/=]{64,}"
#: What a bundler leaves in a path or a content.
BUILD_PARTS = ("dist/", "build/", "bundle/", "generator-build/")
BUILD_SIGNS = ("/* webpack", "__webpack_require__", "/* babel", "rollupChunk", "//# sourceMappingURL=")


def byte_entropy(data: Column) -> Column:
    """Bits per byte of a binary; 0 for none.  A histogram of at most 256 values by lengths, without a row or an element for each byte."""
    # one character a byte
    text = F.decode(data, "ISO-8859-1")
    distinct = F.array_distinct(F.split(text, ""))
    total = F.octet_length(data).cast("double")
    counts = F.transform(F.filter(distinct, lambda c: c != ""), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    sums = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n * F.log2(n))
    return F.when(total > 0, F.log2(total) - sums / total).otherwise(0.0)


def hidden_runs(files: DataFrame) -> DataFrame:
    """package_name, file_path, line, col, n_points, n_bytes, entropy, payload_class, decoded and severity of each run of 16 variation selectors or more.

    Anything else, a line end too, ends a run; so a line may have several.  ``decoded``
    is null where the bytes aren't UTF-8.  What decodes to bytes of a class is critical;
    every run does, since it has at least four selectors, unless its bytes are undecodable: these are high.
    """
    met = statements(files, {"run": (RUN, None)}).select(*KEY, "line", "col", F.length("found").cast("long").alias("n_points"), F.inline(F.array(F.struct(hidden_bytes(F.col("found")).alias("_data")))))
    met = met.select(*KEY, "line", "col", "n_points", "_data", F.inline(F.array(F.struct(byte_entropy(F.col("_data")).alias("_e")))))
    text = F.col("_data").cast("string")
    decoded = F.when(F.is_valid_utf8(text), text)
    return met.select(*KEY, "line", "col", "n_points", F.octet_length("_data").cast("long").alias("n_bytes"), F.round("_e", 6).alias("entropy"), payload_class(F.col("_data"), F.col("_e")).alias("payload_class"), decoded.alias("decoded"), F.when(decoded.isNotNull(), "critical").otherwise("high").alias("severity"))


def run_findings(runs: DataFrame) -> DataFrame:
    """FINDING of each run."""
    return rows_of(runs.withColumn("f", finding(F.col("line"), "stegano_payload", F.col("severity"), "hidden payload in variation selectors", col=F.col("col"))))


def literal_of(line: Column) -> Column:
    """The first long literal of a line: a quoted one, or else a template; null without one."""
    quoted = F.coalesce(F.nullif(F.regexp_extract(line, QUOTED, 1), F.lit("")), F.nullif(F.regexp_extract(line, QUOTED, 2), F.lit("")))
    return F.coalesce(quoted, F.nullif(F.regexp_extract(line, TEMPLATE, 1), F.lit("")))


def is_build_output(path: Column, content: Column) -> Column:
    return X.contains_any(F.lower(path), BUILD_PARTS) | X.contains_any(content, BUILD_SIGNS)


def encrypted_payloads(files: DataFrame) -> DataFrame:
    """package_name, file_path, line, entropy of files that hold a blob of high entropy, decrypt and execute; built and minified files are left out.

    A blob is a run of 64 hexadecimal or base64 characters, or a line's first literal of
    64 characters, of more than 4.5 bits a byte; ``entropy`` is the greatest.  The line is that of the
    first hexadecimal run, else of the first base64 run, else of the first such literal.
    """
    path, content = F.col("file_path"), F.col("content")
    wanted = files.where(content.rlike(V.DECRYPT) & content.rlike(V.EXEC)).where(~gates.is_bundled(path, content) & ~gates.is_minified_file(path, content) & ~is_build_output(path, content))
    kinds = [F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(0)), lambda m, k=k: F.struct(F.lit(k).alias("kind"), m.alias("blob"))) for k, p in enumerate((HEX_RUN, BASE64_RUN))]
    literal = F.when(literal_of(F.col("line")).isNotNull(), F.array(F.struct(F.lit(2).alias("kind"), literal_of(F.col("line")).alias("blob"))))
    lines = wanted.select(*KEY, F.posexplode(X.lines_of(content)).alias("n", "line")).where(F.length("line") >= BLOB_BYTES)
    blobs = lines.select(*KEY, (F.col("n") + 1).cast("long").alias("n"), F.inline(F.concat(*kinds, F.coalesce(literal, F.array().cast("array<struct<kind:int,blob:string>>")))))
    blobs = blobs.select(*KEY, "n", "kind", F.inline(F.array(F.struct(F.encode("blob", "UTF-8").alias("_b"))))).withColumn("entropy", byte_entropy(F.col("_b")))
    counted = (F.octet_length("_b") >= BLOB_BYTES) & (F.col("entropy") > ENTROPY)
    of = lambda k, when=None: F.min(F.when((F.col("kind") == k) & (F.lit(True) if when is None else when), F.col("n")))
    per_file = blobs.groupBy(*KEY).agg(F.coalesce(of(0), of(1), of(2, counted)).alias("line"), F.max(F.when(counted, F.col("entropy"))).alias("entropy"))
    return per_file.where("entropy IS NOT NULL").withColumn("entropy", F.round("entropy", 6))


def payload_findings(found: DataFrame) -> DataFrame:
    """FINDING of each file of ``encrypted_payloads``."""
    return rows_of(found.withColumn("f", finding(F.col("line"), "encrypted_payload", "high", "encrypted payload with dynamic execution")))


#: What a hand-written stream cipher does, by kind, and the confidence for so many kinds.
CIPHER_SIGNS = {
    "init_256": r"(?:new\s+Array\s*\(\s*256\s*\)|\b(?:i|j|k|n)\s*<\s*256\b)",
    "xor_op": r"\^",
    "mod_256": r"(?:%\s*256\b|&\s*0x[fF]{2}\b|&\s*255\b)",
    "swap": r"(?:tmp|temp|t)\s*=\s*\w+\[\w+\];\s*\w+\[\w+\]\s*=\s*\w+\[\w+\];\s*\w+\[\w+\]\s*=\s*(?:tmp|temp|t)",
    "charcode": r"(?:charCodeAt|fromCharCode|String\.fromCharCode)",
}
CIPHER_CONFIDENCE = {3: 0.5, 4: 0.7, 5: 0.85}
#: A call that runs code, without the name of what it is given.
RUNS_CODE = r"\b(?:eval|new\s+Function|execSync|exec|runIn(?:This|New)?Context)\s*\("


def stream_ciphers(files: DataFrame) -> DataFrame:
    """package_name, file_path, line, kinds, confidence of production files with three kinds of CIPHER_SIGNS or more and a call that runs code; one row a file, at its first such call.

    Tests, data and built files are left out; a null content has no signs.
    """
    present = F.filter(F.array(*(F.when(F.col("content").rlike(p), F.lit(kind)) for kind, p in CIPHER_SIGNS.items())), lambda k: k.isNotNull())
    wanted = files.where(X.path_class(F.col("file_path")) == "production").where(F.col("content").rlike(RUNS_CODE)).select(*KEY, "content", F.inline(F.array(F.struct(present.alias("kinds")))))
    wanted = wanted.where(F.size("kinds") >= 3)
    before = F.regexp_extract("content", rf"(?s)^(.*?){RUNS_CODE}", 1)
    confidence = F.element_at(F.create_map(*(F.lit(x) for pair in CIPHER_CONFIDENCE.items() for x in pair)), F.size("kinds"))
    return wanted.select(*KEY, (line_ends(before) + 1).alias("line"), F.array_join("kinds", ",").alias("kinds"), confidence.alias("confidence"))


def cipher_findings(found: DataFrame) -> DataFrame:
    """FINDING of each file of ``stream_ciphers``."""
    return rows_of(found.withColumn("f", finding(F.col("line"), "rc4_pattern", "info", "stream cipher near dynamic execution", F.col("confidence"))))
