"""Rows of tables: 128-bit identities, names that don't clash, and running sums over a global order."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auspex.sources.shared import materialize


def identity(*columns: Column | str) -> Column:
    """128 bits of the values; null differs from every value, and values don't run into each other."""
    marked = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        marked.append(F.when(text.isNull(), "n").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.md5(F.concat(*marked)))


def carried(df: DataFrame, *out: str) -> list[str]:
    """The columns of ``df`` without those named like one of ``out``, in any case."""
    return [c for c in df.columns if c.lower() not in {o.lower() for o in out}]


def own_names(df: DataFrame) -> dict[str, str]:
    """A name for each column of ``df`` that no column of an operator has."""
    return {c: f"_own_{k}_{c}" for k, c in enumerate(df.columns)}


def tidied(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which a worker gives back what it freed: workers stay for later tasks, beside them."""

    def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # GNU's C library has it
                trim(0)

    return tidy


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (a long without nulls) over the rows before, in the order of the columns ``order``.

    The order is cut in ranges; each is summed where it is sorted, and the ranges'
    sums, a row for each, are added up.  The result is read from a table.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [*rows.columns, "_range", "_inside"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, range_ = 0, TaskContext.get().partitionId()
        for batch in batches:
            sums = total + np.cumsum(batch.column(value).to_numpy(), dtype=np.int64)
            if len(sums):
                total = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sums), range_, np.int32)), pa.array(sums)], names)

    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_inside", T.LongType())])
    placed = materialize(dealt.mapInArrow(tidied(run), schema), "order")
    ahead = F.coalesce(F.sum("_sum").over(Win.orderBy("_range").rowsBetween(Win.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", ahead.alias("_ahead"))
    # a row for each range: no more than there are shuffle partitions
    return placed.join(F.broadcast(ranges), "_range").withColumn(name, F.col("_ahead") + F.col("_inside") - F.col(value)).select(*rows.columns, name)
