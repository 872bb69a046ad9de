"""Gates on files and findings: bundled and minified files, documentation, sizes, severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auspex.functions import text as X
from auspex.functions import values as V
from auspex.operators.rows import KEY

# Parts of paths and contents that tell built files from sources.
#: A file's origin: lower-cased path, then content.
BUNDLED_PARTS = ("/dist/", "/build/", "/bin/", ".min.", ".bundle.", ".umd.")
BUNDLED_ENDS = (".mjs", ".cjs")
BUNDLED_CONTENT = ("/* webpack", "/* rollup", "/* parcel", "/*! For license information", "__webpack_require__", "__ROLLUP__")
#: Minified files: path as it is, lower-cased path, content.
MINIFIED_PARTS = (
    "/dist/", "/build/", "/lib/", "/bin/", "/out/", "/bundle/", "/compiled/", "/generated/", "/.next/", "/.nuxt/", "/.output/", "/umd/", "/esm/", "/cjs/",
    ".min.", ".bundle.", ".umd.", ".esm.", ".cjs.", ".webpack.", ".rollup.", ".babel.", ".swc.",
)
BUNDLERS = ("webpack", "rollup", "babel", "swc", "esbuild", "vite", "parcel", "browserify", "gulp", "grunt")
BUNDLE_SIGNATURES = ("webpackJsonp", "__webpack_require__", "webpackChunk", "rollupChunk", "__rollup__", "babelHelpers", "esbuild", "parcelRequire", "browserify")
#: The scanner's own list, on the lower-cased path.
BUILT_PARTS = (".min.", ".bundle.", ".umd.", "/dist/", "/build/", "/bin/", "/out/", "/gyp/", "/lib/")
BUILT_ENDS = (".mjs", ".cjs", "-dist.js", "-prod.js")
DOCUMENT_ENDS = (".md", ".mdx", ".txt", ".rst")
LARGE_BYTES, VERY_LARGE_BYTES = 500_000, 1_000_000

#: Categories of hidden payloads, which built files have by chance.
HIDDEN = ("stego_pattern", "stegano_payload", "pipe_delimiter_stego")


def _ends(path: Column, ends: tuple[str, ...]) -> Column:
    return X.any_of(path.endswith(e) for e in ends)


def is_bundled(path: Column, content: Column) -> Column:
    low = F.lower(path)
    return X.contains_any(low, BUNDLED_PARTS) | _ends(low, BUNDLED_ENDS) | X.contains_any(content, BUNDLED_CONTENT)


def is_minified_file(path: Column, content: Column) -> Column:
    """By path, or by whole bytes per line on average, few lines in a large file, or a bundler's signature; an empty file only by path."""
    size, lines = F.octet_length(content), F.size(X.lines_of(content))
    dense = (size >= 201 * lines) | ((size > 10_000) & (lines < F.floor(size / 500)))
    by_content = (size > 0) & (dense | X.contains_any(content, BUNDLE_SIGNATURES))
    return X.contains_any(path, MINIFIED_PARTS) | X.contains_any(F.lower(path), BUNDLERS) | F.coalesce(by_content, F.lit(False))


def with_gates(files: DataFrame) -> DataFrame:
    """Each file's gates; null content is empty."""
    low, content = F.lower("file_path"), F.coalesce("content", F.lit(""))
    size = F.octet_length(content)
    return files.select(
        *KEY,
        is_bundled(F.col("file_path"), content).alias("is_bundled"),
        is_minified_file(F.col("file_path"), content).alias("is_minified"),
        _ends(low, DOCUMENT_ENDS).alias("is_documentation"),
        (X.path_class(F.col("file_path")) == "test").alias("is_test"),
        (size > LARGE_BYTES).alias("is_large"),
        (size > VERY_LARGE_BYTES).alias("is_very_large"),
        (X.contains_any(low, BUILT_PARTS) | _ends(low, BUILT_ENDS) | (size > LARGE_BYTES)).alias("likely_built"),
    )


def gated(findings: DataFrame, gates: DataFrame) -> DataFrame:
    """Findings that the scanner reports (files without gates pass them): none of characters in documentation and tests; in built files only critical characters and no hidden payload."""
    source = ~F.col("is_documentation") & ~F.col("is_test")
    category = F.col("category")
    passes = (
        F.when(category == "invisible_character", source & (~F.col("likely_built") | (F.col("severity") == "critical")))
        .when(category == "homoglyph", source)
        .when(category.isin(*HIDDEN), source & ~F.col("likely_built"))
        .otherwise(True)
    )
    return findings.join(gates.select(*KEY, "is_documentation", "is_test", "likely_built"), list(KEY), "left").where(F.coalesce(passes, F.lit(True))).select(*findings.columns)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of that severity and above."""
    return findings.where(X.severity_rank(F.col("severity")) >= V.SEVERITIES.index(severity))
