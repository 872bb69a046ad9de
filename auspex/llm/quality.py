"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths.

One pass over the texts without a shuffle.  For each length in ``COVERAGE`` the
words' hashes are rolled to n-gram hashes in numpy; the characters inside n-grams
that a text has twice or more are its coverage at that length.

Defined cases: a null or empty text has no words and fails the base rule; a text
with fewer words than a length has no n-gram of it; rows are judged one by one,
so repeated rows get equal verdicts; a very long text is one slice of its task's work;
an empty table gives an empty result; other columns are passed on as they are, and
by ``with_measures`` those named like a measure (in any case) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auspex.llm import words as W
from auspex.llm.rows import carried, own_names, tidied

MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
#: Of the characters in words, the percentage that may lie in repeated n-grams, by length.
COVERAGE = {5: 20, 7: 18, 10: 15}
#: And in lines that repeat an earlier line.
LINE_PERCENT = 25

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in COVERAGE))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text."""
    w = W.find_words(texts)
    whole = w.in_word & ((w.data & 0xC0) != 0x80)  # the first byte of each code point of a word
    chars = W.prefix(whole)
    of_word = chars[w.ends] - chars[w.starts]
    text_of = w.text_of
    salt = W.mix64(text_of.astype(np.uint64) + np.uint64(1))
    out = {"n_words": np.diff(w.first), "word_chars": w.per_text(whole), "n_symbols": w.per_text(_SYMBOL[w.data])}

    line_text, line_start, line_end = _lines(w)
    line_chars = chars[line_end] - chars[line_start]
    real = line_chars > 0
    line_text, line_chars = line_text[real], line_chars[real]
    keys = W.mix64(W.span_hashes(w.data, line_start[real], line_end[real]) ^ W.mix64(line_text.astype(np.uint64) + np.uint64(1)))
    _, firsts = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[firsts] = False
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=w.n_texts)
    out["dup_line_chars"] = np.bincount(line_text[later], weights=line_chars[later], minlength=w.n_texts).astype(np.int64)

    hashes, rolled, n = w.hashes(), None, 1
    rolled = hashes
    for length in sorted({WINDOW, *COVERAGE}):
        while n < length:
            n += 1
            rolled = W.rolling(hashes, n, rolled)
        full = np.flatnonzero(W.full_windows(w.first, length))
        at = full[W.repeated(W.mix64(rolled[full] ^ salt[full]))]
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + length, -1)
        covered = np.cumsum(depth[:-1]) > 0
        if length == WINDOW:
            out["n_repeat_words"] = np.bincount(text_of[covered], minlength=w.n_texts)
        if length in COVERAGE:
            out[f"dup_chars_{length}"] = np.bincount(text_of[covered], weights=of_word[covered], minlength=w.n_texts).astype(np.int64)
    return {k: out[k].astype(np.int64) for k in MEASURES}


def _lines(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of every line that \\n ends or a text's end does."""
    breaks = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate([w.at[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([w.at[1:], breaks]), kind="stable")
    text_of = np.repeat(np.arange(w.n_texts), 1 + np.diff(np.searchsorted(breaks, w.at)))
    return text_of, starts, ends


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and its MEASURES; a column of such a name is replaced."""
    keep = carried(docs, *MEASURES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, text):
            found = measure(part.column(text))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(found[m]) for m in MEASURES)], [*keep, *MEASURES])

    kept = docs.select(keep)
    return kept.mapInArrow(tidied(run), T.StructType([*kept.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def with_verdict(measured: DataFrame) -> DataFrame:
    """base_failed by the base rule, kept if the coverage is low at every length too."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    good = 100 * F.col("dup_line_chars") <= LINE_PERCENT * F.col("word_chars")
    for n, most in COVERAGE.items():
        good &= 100 * F.col(f"dup_chars_{n}") <= most * F.col("word_chars")
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    own = own_names(docs)
    judged = with_verdict(with_measures(docs.withColumnsRenamed(own), own[text])).where("kept")
    return judged.select(*(F.col(f"`{name}`").alias(c) for c, name in own.items()))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_verdict(with_measures(docs)).drop("text")


def _covered(n: int) -> str:
    """DuckDB: words inside n-word windows that a text has twice or more."""
    return f"""
      SELECT DISTINCT doc_row, pos + k AS pos FROM (
        SELECT doc_row, pos, count(*) OVER (PARTITION BY doc_row, gram) AS seen FROM (
          SELECT doc_row, pos, list_aggregate(list(word) OVER (PARTITION BY doc_row ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING), 'string_agg', ' ') AS gram,
                 n - pos >= {n - 1} AS fits FROM w) WHERE fits), range({n}) AS r(k) WHERE seen > 1"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc_row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_row, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
w AS (SELECT doc_row, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos, len(ws) AS n FROM l),
base AS (SELECT doc_row, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY 1),
lines AS (SELECT doc_row, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_row, sum(n - 1)::BIGINT AS n_dup_lines, sum((n - 1) * length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')))::BIGINT AS dup_line_chars
  FROM (SELECT doc_row, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1),
{", ".join(f"c{n} AS ({_covered(n)}), s{n} AS (SELECT doc_row, count(*) AS n, sum(length(word))::BIGINT AS chars FROM c{n} JOIN w USING (doc_row, pos) GROUP BY 1)" for n in COVERAGE)},
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(s{WINDOW}.n, 0) AS n_repeat_words,
  coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(s{n}.chars, 0) AS dup_chars_{n}" for n in COVERAGE)}
  FROM d LEFT JOIN base USING (doc_row) LEFT JOIN dup USING (doc_row) {" ".join(f"LEFT JOIN s{n} USING (doc_row)" for n in COVERAGE)})
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * dup_line_chars <= {LINE_PERCENT} * word_chars
  AND {" AND ".join(f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in COVERAGE.items())} AS kept
FROM m"""
