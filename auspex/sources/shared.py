"""Intermediate tables in the folder that the whole cluster shares, and joins that spread hot keys."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one of so many rows is heavy; there are fewer heavy keys than that.
HEAVY = 1024
#: A task of costly work on rows gets about so many bytes of its input, and this many times its share of rows at most.
SPREAD_BYTES, SPREAD_SHARE = 16 << 20, 2


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Without one, a session on a single machine (tests) gets its own; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="auspex-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/auspex/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that it ran, and a
    table that several later steps read is computed once.  Tables stay until their
    folder is cleared, but for those that ``discard`` removes.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def _located(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` as it names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate files."""
    fs, where = _located(spark, path)
    fs.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.table_path)


def swept(spark: SparkSession) -> None:
    """Have Spark remove the files of shuffles that no table needs any more: it learns of them when the driver collects garbage, else only when its memory is full."""
    for _ in range(2):  # Python's tables go first, then what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


_ONCE: dict[tuple, DataFrame] = {}


def input_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table, those in nested folders too, which tell whether it has changed."""
    fs, where = _located(spark, path)
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        s = files.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(found))


def once(spark: SparkSession, name: str, path: str, make) -> DataFrame:
    """The table that ``make`` gives for the input at ``path``, written once a session for each state of it, and again if it was cleared away."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, input_state(spark, path))
    if key in _ONCE:
        fs, written = _located(spark, f"{_ONCE[key].table_path}/_SUCCESS")
        if fs.exists(written):
            return _ONCE[key]
    _ONCE[key] = materialize(make(), name)
    return _ONCE[key]


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew over all cores, and over more tasks if it is large, unless its partitions share the rows out already.

    A split of a Parquet file has the rows of whole row groups, so that of few large ones most splits are empty.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))
    most, total = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count("*").alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    return df if (most or 0) * parts <= SPREAD_SHARE * (total or 0) else df.repartition(parts)


def join_keyed(rows: DataFrame, dims: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``dims`` for their ``key`` (one a key), which also tells how many rows the key has.

    Heavy keys, fewer than HEAVY, are broadcast, so their rows stay where they are;
    the rows of the others are shuffled, and no task gets many of one key.
    """
    total = dims.agg(F.sum(count)).first()[0] or 0
    heavy, light = dims.where(F.col(count) * HEAVY > total), dims.where(F.col(count) * HEAVY <= total)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return rows.join(F.broadcast(heavy), key).select(*rest.columns).unionByName(rest)


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """A column name for each of ``names`` that ``df`` doesn't have yet (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        free = f"_{name}"
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out[name] = free
    return out
