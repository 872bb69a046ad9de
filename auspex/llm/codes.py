r"""Vector code compression: product quantization by partial-distance search.

Vectors are cut in ``PARTS`` parts, and each part is replaced by the index of an
entry in its position's codebook.  The nearest entry is found by partial distances:
dimensions are taken in descending variance of the codebook, and an entry is dropped
as soon as its accumulated distance strictly exceeds the best complete distance that
its vector has so far.  The masks are numpy arrays over many vectors at once; after
each step the most promising entry left is completed, which lowers the bound.

A round assigns all vectors and sums each entry's parts where they are; only sums by
entry are shuffled, and ``ENTRIES`` x dimensions sums come to the driver.  All
arithmetic is in integers: int32 or int64 where they hold every distance, else
Python's.

Defined cases: vectors that are null or hold a null or non-finite component are
dropped; an empty vector has distance 0; components beyond 2^62 are cut to it and
results to the ends of a long; vectors of each length have codebooks of their own (a
job for each length), and a length that parts don't divide is cut as evenly as can
be; with fewer rows than ``ENTRIES`` the codebook is as long as there are rows; a null
vec_id comes last, equal vec_ids are in the order of their vectors; equal rows get
equal results; an empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.llm.rows import tidied
from auspex.sources.shared import join_keyed, materialize, spread

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors compared with a codebook at a time; dimensions between two tests of the masks.
BLOCK, STEP = 2048, 2
END = 2**62

#: The codebooks of each length: a matrix of entries x components for each part.
Books = dict[int, list[np.ndarray]]


def quantized(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label_key (not null) and ``q``, the floor(1024 * x) as longs, of the rows that take part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = vectors.where(F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False)))
    end = F.lit(float(END))
    named = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    return fine.select(F.col(vec_id).alias("vec_id"), named.alias("label_key"), F.transform(x, lambda v: F.floor(F.greatest(F.least(v * SCALE, end), -end)).cast("long")).alias("q"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows with ``q`` of one length, and their matrix."""
    lists = batch.column("q")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n)


def cuts(dims: int) -> list[tuple[int, int]]:
    """Begin and end of each part."""
    return [(dims * p // PARTS, dims * (p + 1) // PARTS) for p in range(PARTS)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each row of ``x``; of equal ones the lowest."""
    n, dims = x.shape
    if not n or not dims:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    widest = max(abs(int(f(a))) for a in (x, book) for f in (np.min, np.max)) * 2
    kind = np.int32 if widest**2 * dims < 2**31 else np.int64 if widest**2 * dims < 2**63 else object
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    book = np.ascontiguousarray(book[:, order].astype(kind))
    found = [_nearest(x[k : k + BLOCK][:, order].astype(kind), book) for k in range(0, n, BLOCK)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, dims = x.shape
    depth = min(dims, 2 * STEP)
    partial = np.zeros((n, len(book)), x.dtype)
    for k in range(depth):
        partial += (x[:, k, None] - book[None, :, k]) ** 2
    best = _completed(x, book, np.arange(n), partial.argmin(1), partial.min(1), depth)
    row, entry = np.nonzero(partial <= best[:, None])
    partial = partial[row, entry]
    while depth < dims:
        for k in range(depth, min(dims, depth + STEP)):
            partial += (x[row, k] - book[entry, k]) ** 2
        depth = min(dims, depth + STEP)
        left = partial <= best[row]
        row, entry, partial = row[left], entry[left], partial[left]
        if depth < dims and len(row) > n:
            first, least = _leaders(row, partial, n)
            best = np.minimum(best, _completed(x, book, np.arange(n), entry[first], least, depth))
    first, least = _leaders(row, partial, n)
    return entry[first], least


def _completed(x: np.ndarray, book: np.ndarray, row: np.ndarray, entry: np.ndarray, partial: np.ndarray, depth: int) -> np.ndarray:
    return partial + ((x[row, depth:] - book[entry, depth:]) ** 2).sum(1)


def _leaders(row: np.ndarray, partial: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's least partial distance is first, and that distance; every row has an entry left, in ascending order."""
    begin = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(partial, begin)
    at = np.flatnonzero(partial == least[row])
    return at[np.searchsorted(row[at], np.arange(n))], least


def first_books(rows: DataFrame) -> Books:
    """Of each length, the parts of the ``ENTRIES`` smallest vec_ids."""
    lengths = [r[0] for r in rows.groupBy(F.size("q")).count().collect()]
    books = {}
    for dims in lengths:
        smallest = rows.where(F.size("q") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
        x = np.array([r[0] for r in smallest], np.int64).reshape(len(smallest), dims)
        books[dims] = [x[:, a:b] for a, b in cuts(dims)]
    return books


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entry of each part (vectors x parts), and the distances of each part."""
    found = [nearest(x[:, a:b], book) for (a, b), book in zip(cuts(x.shape[1]), books, strict=True)]
    return np.stack([f[0] for f in found], 1), [f[1] for f in found]


def entry_sums(rows: DataFrame, books: Books) -> DataFrame:
    """dims, part, entry, place, total and n: the sums of the components that are assigned to an entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(d, p): np.zeros(book.shape, object) for d, own in books.items() for p, book in enumerate(own)}
        counts = {k: np.zeros(len(v), np.int64) for k, v in sums.items()}
        for batch in batches:
            for _, x in by_length(batch):
                dims = x.shape[1]
                exact = x if abs(int(x.min(initial=0))) + int(x.max(initial=0)) < 2**62 // max(1, len(x)) else x.astype(object)
                entry, _ = assigned(x, books[dims])
                for p, (a, b) in enumerate(cuts(dims)):
                    own = np.zeros((len(books[dims][p]), b - a), exact.dtype)
                    np.add.at(own, entry[:, p], exact[:, a:b])
                    sums[dims, p] = sums[dims, p] + own
                    counts[dims, p] += np.bincount(entry[:, p], minlength=len(own))
        for (dims, p), total in sums.items():
            used = np.flatnonzero(counts[dims, p])
            if len(used):
                yield pa.RecordBatch.from_pydict({
                    "dims": pa.array([dims] * len(used), pa.int32()), "part": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()), "n": pa.array(counts[dims, p][used]),
                    "totals": pa.array([[Decimal(int(v)) for v in total[k]] for k in used], pa.list_(pa.decimal128(38, 0))),
                })

    found = rows.select("q").mapInArrow(tidied(run), "dims int, part int, entry int, n long, totals array<decimal(38,0)>")
    placed = found.select("dims", "part", "entry", "n", F.posexplode("totals").alias("place", "total"))
    return placed.groupBy("dims", "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def next_books(rows: DataFrame, books: Books) -> Books:
    """Each used entry becomes the floor of its parts' mean; ENTRIES x dimensions sums come to the driver."""
    out = {d: [book.copy() for book in own] for d, own in books.items()}
    for r in entry_sums(rows, books).collect():
        out[r["dims"]][r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def fitted(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    """The codebooks after ``rounds`` rounds over all ``rows`` of ``quantized``."""
    books = first_books(rows)
    for _ in range(rounds):
        books = next_books(rows, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """Of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def coded(rows: DataFrame, books: Books) -> DataFrame:
    """vec_id, label_key, code, error and codebooks_sha256 of all ``rows``."""
    digests = {d: digest(own) for d, own in books.items()}
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch):
                entry, distances = assigned(x, books[x.shape[1]])
                digits = entry.astype(np.uint8).tobytes().hex()
                error = np.minimum(np.array(distances, object).sum(0), 2**63 - 1)
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([
                    own.column("vec_id"), own.column("label_key"), pa.array([digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)], pa.string()),
                    pa.array(error.tolist(), pa.int64()), pa.array([digests[x.shape[1]]] * len(at), pa.string()),
                ], ["vec_id", "label_key", "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(tidied(run), f"vec_id {kind}, label_key string, code string, error long, codebooks_sha256 string")


def decoded(codes: DataFrame, books: Books, dims: int, out: str = "q") -> DataFrame:
    """``codes`` with the integer vector that each ``code`` stands for."""
    own, keep = books[dims], [c for c in codes.columns if c.lower() != out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, PARTS)
            x = np.concatenate([book[entry[:, p]] for p, book in enumerate(own)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, out])

    kept = codes.select(keep)
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"{out} array<long>"]))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = materialize(quantized(spread(vectors)), "code-vectors")
    found = materialize(coded(rows, fitted(rows)), "codes")
    labels = found.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("*").alias("_rows"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    labels = materialize(labels.withColumn("label_error", F.least("label_error", most).cast("long")), "label-errors")
    return join_keyed(found, labels, "label_key", "_rows").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(k: int) -> str:
    """DuckDB: the assignment to codebook ``k``, and codebook k + 1."""
    return f"""
a{k} AS MATERIALIZED (SELECT r, p, min(d * {ENTRIES} + e) AS best FROM (
  SELECT r, x.p, e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM x JOIN b{k} AS b ON x.p = b.p) GROUP BY 1, 2),
t{k} AS (SELECT p, e, list(m ORDER BY place) AS v FROM (
  SELECT p, e, place, (s - ((s % n) + n) % n) // n AS m FROM (SELECT p, (best % {ENTRIES})::INTEGER AS e, place, sum(c) AS s, count(*) AS n
    FROM (SELECT a.p, best, unnest(v) AS c, unnest(range(len(v))) AS place FROM a{k} AS a JOIN x USING (r, p)) GROUP BY 1, 2, 3)) GROUP BY 1, 2),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(t.v::BIGINT[], b.v) AS v FROM b{k} AS b LEFT JOIN t{k} AS t USING (p, e))"""


#: The same rounds, every distance in full; for vectors of one length that the parts divide.
ORACLE_SQL = f"""
WITH q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
x AS MATERIALIZED (SELECT r, p::INTEGER AS p, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] AS v FROM q, range({PARTS}) AS o(p)),
b0 AS MATERIALIZED (SELECT p, (r - 1)::INTEGER AS e, v FROM x WHERE r <= {ENTRIES}),{",".join(_round(k) for k in range(ROUNDS + 1))},
c AS (SELECT r, string_agg(format('{{:02x}}', (best % {ENTRIES})::INTEGER), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM q JOIN c USING (r), s"""
