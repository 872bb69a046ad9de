r"""Sharding by jump consistent hashing.

A row's shard depends on its key and the number of shards alone.  The key's hash
seeds a walk over shard numbers that jumps ahead to the next number at which the
key would move; its last stop below the number of shards is the shard.  There is no
table of a ring, and when shards are appended, a row stays or moves into a new one.

The walk runs in numpy on the hashes only; texts stay in the JVM.  A shard's rows
are numbered from 0 by running sums over range-sorted rows (``rows.running_sum``),
so no task holds a shard.  Equal rows are told apart by a salt that is
written down before they are sorted, so a key may have any share of all rows.

Defined cases: a null key is a key of its own; a null text has no bytes (size 8) and
the checksum of the empty text, 0; a very long text isn't moved, only its size and
checksum are; rows of one key are in one shard, in the order of checksum, size and
identity, and equal rows in any order; an empty table gives an empty result; other
columns are carried, those named like a result (in any case) are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.llm.rows import carried, identity, running_sum
from auspex.sources.shared import materialize

SHARDS = 24
#: Bytes that a record has besides its text.
OVERHEAD = 8
#: Rows in a file of ``write_shards``.
FILE_ROWS = 1_000_000

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard of each 64-bit key among ``n``, all keys in lockstep; about ln n + 1 steps."""
    if n < 1:
        raise ValueError("there is no shard")
    state, stop, ahead = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    walking = np.arange(len(keys))
    while len(walking):
        stop[walking] = at = ahead[walking]
        state[walking] = now = state[walking] * _STEP + np.uint64(1)
        ahead[walking] = there = ((at + 1) * (2.0**31 / ((now >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        walking = walking[there < n]
    return stop


def key_hash(key: Column) -> Column:
    """64 bits of the key's text form, as a signed long; null is a key too."""
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def shard_of(key: Column, n: int) -> Column:
    """The shard of ``key`` among ``n``."""

    @F.pandas_udf("int")
    def walked(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), n).astype(np.int32))

    return walked(key_hash(key))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def with_slots(sharded: DataFrame, order: list[str], shard: str = "shard", out: str = "slot") -> DataFrame:
    """``sharded`` with the number of each row in its shard, from 0, in the order of the columns ``order``."""
    keep = carried(sharded, out)
    salted = sharded.select(*keep, F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()).alias("_salt"), F.lit(1).cast("long").alias("_one"))
    placed = running_sum(materialize(salted, "shard-rows"), [shard, *order, "_salt"], "_one", "_at")
    firsts = placed.groupBy(shard).agg(F.min("_at").alias("_first"))  # a row a shard
    return placed.join(F.broadcast(firsts), shard).withColumn(out, F.col("_at") - F.col("_first")).select(*keep, out)


def moved(docs: DataFrame, before: int, after: int, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that leave their shard when ``before`` shards become ``after``, with from_shard and to_shard."""
    keep = carried(docs, "from_shard", "to_shard")
    both = docs.select(*keep, shard_of(F.col(key), before).alias("from_shard"), shard_of(F.col(key), after).alias("to_shard"))
    return both.where("from_shard <> to_shard")


def write_shards(docs: DataFrame, path: str, n: int, key: str = "doc_id", file_rows: int = FILE_ROWS) -> None:
    """Write ``docs`` as Parquet under ``path``, a folder ``shard=k`` for each shard, in files of at most ``file_rows`` rows."""
    keep = carried(docs, "shard")
    docs.select(*keep, shard_of(F.col(key), n).alias("shard")).write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key, text = F.col("doc_id"), F.col("text")
    sharded = docs.select(
        "doc_id", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, SHARDS).alias("shard"), shard_of(key, SHARDS + 1).alias("grown_shard"), identity(text).alias("_k"),
    )
    placed = with_slots(sharded, ["doc_id", "text_crc32", "size", "_k"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The same walk by recursion; the checksum by its table of 256 remainders.
ORACLE_SQL = f"""
WITH RECURSIVE remainder AS (SELECT list(c ORDER BY b) AS of_byte FROM (
  SELECT b, list_reduce(list_concat([b], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(b))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, strlen(text) + {OVERHEAD} AS size,
  xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, of_byte[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
  md5(text) AS k FROM d, remainder),
walk AS (SELECT r, ('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, 'null')), 1, 16))::UBIGINT::HUGEINT AS state, -1::BIGINT AS stop, 0::BIGINT AS ahead FROM d
  UNION ALL SELECT r, state, ahead, floor((ahead + 1) * (2147483648::DOUBLE / (state // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, ahead, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS state FROM walk WHERE ahead <= {SHARDS})),
placed AS (SELECT r, (max(stop) FILTER (WHERE stop < {SHARDS}))::INTEGER AS shard, max(stop)::INTEGER AS grown_shard FROM walk GROUP BY r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size, k) - 1 AS slot, grown_shard
FROM s JOIN placed USING (r)"""
