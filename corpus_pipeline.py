"""The corpus pipeline: documents in, encoded training documents out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns a DataFrame; ``run`` writes it as Parquet to the shared folder and rereads
it as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auspex.llm import bpe, mixing, neardup, passages, quality
from auspex.sources.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_quality(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the document of the smallest doc_id stays."""
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an other document keeps are cut out."""
    return passages.cut_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, in its order."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, in place of it."""
    path, pattern = bpe.byte_bpe_50k()
    return bpe.with_ids(docs, path, pattern, keep_text=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Chaining, clustering and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
