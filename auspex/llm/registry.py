"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auspex.llm import bpe, chat, codes, langid, licenses, mixing, neardup, passages, phrases, quality, sharding, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_warc": warc.op3_warc,
    "op4_substring_dedup": passages.op4_substring_dedup,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_mixing": mixing.op6_mixing,
    "op7_language_id": langid.op7_language_id,
    "op8_jaccard_join": neardup.op8_jaccard_join,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_bpe": bpe.op10_bpe,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_sharding": sharding.op12_sharding,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES: dict[str, str] = {
    "op1_chat_formatting": chat.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op5_exact_topk": topk.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op11_vector_codes": codes.ORACLE_SQL,
    "op12_sharding": sharding.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
