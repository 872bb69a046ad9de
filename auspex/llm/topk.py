"""Top-k search by Fagin's threshold algorithm over blocks of alike vectors.

Vectors are dealt to cells by the nearest of ``PIVOTS`` pivots, and cells are cut in
blocks.  Inner products don't change when the axes are turned, so a block has axes of
its own: the direction of its mean, then those along which its vectors vary most,
``AXES`` at most (all, if a vector has no more components).  For each axis it has the
list of its vectors sorted by that component about the mean, and one more list by the
length of what the axes leave out, which a query weighs by the length of its own
remainder (Cauchy-Schwarz).  The lists are made once.

A query goes down the lists from the end that its weights favour, at each step in
the list that takes most from the threshold a place; a list's steps begin at one place
and double.  Vectors that come into sight are scored in full.  The threshold is the
score that a vector could have whose components are those at the lists' present depths,
and the query is done with the block as soon as its k-th best score is above it.  With
equal scores the smaller id is better, so a threshold that equals the k-th score
doesn't stop the search.  Queries whose threshold is still too high ``SCAN`` of the way
down all lists would see most of the block, so all of it is scored for them together.

A query begins with a block of its own cell.  With the k-th score from there, the
range of a block's components and the distance of its vectors from their mean tell
which other blocks it has to visit; it goes to those only.  Nothing is left
out: where vectors have no structure, all blocks are visited and scored.

Scores are exact integers: components are floor(256 * x) of x as a double; sums
are made in float64 where they fit 53 bits, else in int64, else in Python's integers.

A task holds one block and at most ``GROUP`` queries at a time.  Blocks and queries
meet by equi-joins on the block; the blocks' bounds meet groups of queries in chunks,
so no side is broadcast.

Defined cases: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows without an id; vectors of another length than
the query's aren't candidates of it; rows that share an id are separate
candidates (never of a query with that id), and equal rows are one query; components
beyond the ends of a long are cut to 2^62 and scores to the ends of a long; an empty
table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from auspex.sources.shared import materialize

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Cells; their pivots are the vectors of the smallest hashes.
PIVOTS = 64
#: Vectors in a block, about; queries that a task takes at a time; blocks whose bounds a task takes at a time.
BLOCK, GROUP, BOUNDS = 4096, 2048, 1024
#: Axes of a block; places at both ends of its lists that all queries score first; depth of the test whether to walk, and share in sight that ends a walk.
AXES, HEADS = 8, 8
SCAN, SIGHT = 1 / 4, 1 / 2

#: The score of no candidate; its negative is a long too.
NONE = -(2**63) + 1
LEAST, MOST = NONE + 1, 2**63 - 1


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and ``q``, the floor(256 * x) as longs, of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(whole, F.lit(False)))
    end = F.lit(2.0**62)
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.greatest(F.least(v * SCALE, end), -end)).cast("long")).alias("q"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows with ``q`` of one length, and their matrix."""
    lists = batch.column("q")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)


def celled(rows: DataFrame) -> DataFrame:
    """``rows`` with dims and cell, the number of the nearest pivot of that length (-1 without one)."""
    sample = rows.withColumn("_h", F.xxhash64("vec_id", "q")).orderBy("_h", "vec_id").limit(PIVOTS).collect()
    pivots: dict[int, list[list[int]]] = {}
    for r in sample:
        pivots.setdefault(len(r["q"]), []).append(r["q"])
    matrices = {n: np.array(p, np.float64) for n, p in pivots.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -1, np.int32)
            for at, x in by_length(batch):
                dims[at] = x.shape[1]
                if x.shape[1] in matrices:
                    p = matrices[x.shape[1]]
                    cell[at] = ((p**2).sum(1) - 2 * (x.astype(np.float64) @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(dims), pa.array(cell)], ["vec_id", "q", "dims", "cell"])

    return rows.mapInArrow(run, "vec_id long, q array<long>, dims int, cell int")


BLOCKS = "block long, dims int, cell int, ids binary, vectors binary, axes binary, lists binary, depths binary, low binary, high binary, mean binary, radius double"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("cell", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "axes", "lists", "depths", "low", "high", "mean")), ("radius", pa.float64())])


def packed(x: np.ndarray) -> bytes:
    """Integers in as few bytes as they fit; ``unpacked`` tells the width by the length."""
    kind = next(k for k in (np.int16, np.int32, np.int64) if x.size == 0 or (np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max))
    return x.astype(kind).tobytes()


def unpacked(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (n * dims)]).reshape(n, dims)


def axes_of(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Orthonormal rows: the mean's direction, then those of most variance by a few rounds of subspace iteration.  Any orthonormal rows give right bounds."""
    n = min(AXES, x.shape[1])
    centred = x - mean
    start = np.random.default_rng(0).normal(size=(x.shape[1], n))
    start[:, 0] = mean if mean.any() else start[:, 0]
    basis = np.linalg.qr(start / np.linalg.norm(start, axis=0))[0]
    for _ in range(8):
        spread = centred.T @ (centred @ basis)
        spread[:, 0] = basis[:, 0]
        long = np.linalg.norm(spread, axis=0)
        basis = np.linalg.qr(np.where(long > 0, spread / np.where(long > 0, long, 1), start))[0]
    return basis.T


class Block(NamedTuple):
    """ids (ascending), vectors, axes, and for each axis and the remainder the places in ascending order and their values."""

    ids: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    lists: np.ndarray
    depths: np.ndarray


def block_of(ids: np.ndarray, x: np.ndarray) -> Block:
    real = x.astype(np.float64)
    mean = real.mean(0)
    axes = axes_of(real, mean)
    along = (real - mean) @ axes.T
    values = np.column_stack([along, np.linalg.norm(real - mean - along @ axes, axis=1)])
    lists = np.argsort(values, 0, kind="stable").astype(np.int32)
    return Block(ids, x, mean, axes, lists, np.take_along_axis(values, lists, 0))


def blocks_of(rows: DataFrame) -> DataFrame:
    """BLOCKS of all rows, with the range of each component and the largest distance from the mean."""
    parts = rows.groupBy("dims", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))  # a row a cell: PIVOTS of one length, one of each other
    by = ["dims", "cell", "part"]
    dealt = rows.join(parts, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), F.col("parts"))).repartition(*by).sortWithinPartitions(*by, "vec_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:  # a block ends where a batch does
            keys = [batch.column(c).to_numpy() for c in by]
            cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], 0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    x = batch.column("q").slice(a, b - a).flatten().to_numpy().reshape(b - a, int(keys[0][a]))
                    made = block_of(batch.column("vec_id").slice(a, b - a).to_numpy(), x)
                    yield pa.RecordBatch.from_pydict({
                        "block": [number], "dims": [int(keys[0][a])], "cell": [int(keys[1][a])], "ids": [made.ids.tobytes()], "vectors": [packed(x)],
                        "axes": [made.axes.tobytes()], "lists": [made.lists.tobytes()], "depths": [made.depths.tobytes()], "low": [x.min(0).astype(np.float64).tobytes()], "high": [x.max(0).astype(np.float64).tobytes()],
                        "mean": [made.mean.tobytes()], "radius": [float(np.sqrt(((x - made.mean) ** 2).sum(1).max()))],
                    }, BLOCK_SCHEMA)
                    number += 1

    return dealt.mapInArrow(run, BLOCKS)


#: What a task that searches a block needs of it.
HELD = ("ids", "vectors", "mean", "axes", "lists", "depths")


def block_from(row: dict) -> Block:
    n = row["dims"]
    ids, mean = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["mean"], np.float64)
    axes = np.frombuffer(row["axes"], np.float64).reshape(-1, n)
    shape = (len(ids), len(axes) + 1)
    return Block(ids, unpacked(row["vectors"], len(ids), n), mean, axes, np.frombuffer(row["lists"], np.int32).reshape(shape), np.frombuffer(row["depths"], np.float64).reshape(shape))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products (queries x vectors) as longs, cut to their ends."""
    span = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(vectors.astype(np.float64)).max(initial=0)) * queries.shape[1]
    if span >= 2**63:
        exact = queries.astype(object) @ vectors.T.astype(object)
        return np.clip(exact, LEAST, MOST).astype(np.int64)
    kind = np.float32 if span < 2**24 else np.float64 if span < 2**53 else np.int64
    return (queries.astype(kind) @ vectors.T.astype(kind)).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far, none below ``least``."""

    def __init__(self, least: np.ndarray):
        self.least = least
        self.score = np.full((len(least), K), NONE)
        self.id = np.full((len(least), K), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.least)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of the queries ``rows`` against candidates ``ids`` (ascending); ``own``: the queries' ids."""
        scores = np.where(ids[None, :] == own[rows, None], NONE, scores)
        better = np.flatnonzero(scores.max(1) >= self.kth()[rows])
        for r in better.tolist():
            row, s = rows[r], scores[r]
            if len(s) > K:  # ties with the k-th are kept, the smaller ids win below
                least = np.partition(s, len(s) - K)[len(s) - K]
                above = np.flatnonzero(s > least)
                at = np.concatenate([above, np.flatnonzero(s == least)[: K - len(above)]])
            else:
                at = np.arange(len(s))
            at = at[s[at] > NONE]
            all_s, all_i = np.concatenate([self.score[row], s[at]]), np.concatenate([self.id[row], ids[at]])
            order = np.lexsort((all_i, -all_s))[:K]
            self.score[row], self.id[row] = all_s[order], all_i[order]


#: What rounding in a bound may take away; it is far above the error of sums of float64.
SLACK = 1 + 1e-9


def threshold_search(queries: np.ndarray, own: np.ndarray, block: Block, best: Best) -> int:
    """Search one block for all queries; returns how many of its scores were computed."""
    n, lists, depths = len(block.ids), block.lists, block.depths
    q = queries.astype(np.float64)
    along = q @ block.axes.T
    weights = np.column_stack([along, np.linalg.norm(q - along @ block.axes, axis=1)])
    # a list that a query reads from its end has its values there
    up, down = np.maximum(weights, 0), np.minimum(weights, 0)
    span = np.abs(depths[[0, -1]]).max(0)
    base = q @ block.mean
    base += (np.abs(q) @ np.abs(block.mean) + np.abs(weights) @ span + np.linalg.norm(q, axis=1) * np.linalg.norm(span)) * (SLACK - 1) + 1

    def open_at(rows: np.ndarray, depth: int) -> np.ndarray:
        """The queries that ``depth`` places of all lists don't settle."""
        bound = base[rows] + up[rows] @ depths[n - 1 - depth] + down[rows] @ depths[depth]
        return rows[best.kth()[rows] <= bound]

    def score(rows: np.ndarray, places: np.ndarray) -> int:
        best.add(rows, products(queries[rows], block.vectors[places]), block.ids[places], own)
        return len(rows) * len(places)

    active = open_at(np.arange(len(queries)), 0)
    if not len(active):
        return 0
    headed = np.zeros(n, bool)
    headed[lists[:HEADS].ravel()] = headed[lists[-HEADS:].ravel()] = True
    scored = score(active, np.flatnonzero(headed))
    if headed.all():
        return scored
    active = open_at(active, HEADS)
    whole = open_at(active, max(HEADS, int(n * SCAN)))
    if len(whole):
        scored += score(whole, np.flatnonzero(~headed))
    columns = np.arange(lists.shape[1])
    for r in np.setdiff1d(active, whole).tolist():
        row, weight = np.array([r]), weights[r]
        forward = weight < 0
        seen, at, step = headed.copy(), np.full(len(columns), HEADS), np.ones(len(columns), np.int64)
        value = lambda depth, forward=forward: depths[np.where(forward, depth, n - 1 - depth), columns]
        while max(best.score[r, -1], best.least[r]) <= base[r] + weight @ value(at):
            ahead = np.minimum(at + step, n - 1)
            d = int((np.abs(weight) * np.abs(value(at) - value(ahead)) / step).argmax())
            stop = min(n, int(at[d] + step[d]))
            if seen.sum() > n * SIGHT or stop == n:
                scored += score(row, np.flatnonzero(~seen))
                break
            new = lists[at[d] : stop, d] if forward[d] else lists[n - stop : n - at[d], d]
            new = np.sort(new[~seen[new]])
            seen[new] = True
            at[d], step[d] = stop, 2 * step[d]
            if len(new):
                scored += score(row, new)
    return scored


HITS = "query_id long, query_hash long, vec_id long, score long, scored long"


def search(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """HITS of each query (query_id, query_hash, q, least) in the ``block`` it asks for; a row without vec_id has the number of scores computed."""
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    given = blocks.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id", "query_hash"), F.col("parts")))
    null = lambda kind: F.lit(None).cast(kind)
    left = given.select("block", "part", F.lit(0).alias("side"), "dims", *HELD, null("long").alias("query_id"), null("long").alias("query_hash"), null("array<long>").alias("q"), null("long").alias("least"))
    right = placed.select("block", "part", F.lit(1).alias("side"), null("int").alias("dims"), *(null("binary").alias(c) for c in HELD), "query_id", "query_hash", "q", "least")
    met = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part", "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if waiting:
                own, hashes, least = (np.array([w[k] for w in waiting], np.int64) for k in (0, 1, 3))
                q = np.array([w[2] for w in waiting], np.int64)
                best = Best(least)
                scored = threshold_search(q, own, block, best)
                at, col = np.nonzero(best.score > NONE)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array([*own[at].tolist(), None], pa.int64()), "query_hash": pa.array([*hashes[at].tolist(), None], pa.int64()), "vec_id": pa.array([*best.id[at, col].tolist(), None], pa.int64()),
                    "score": pa.array([*best.score[at, col].tolist(), None], pa.int64()), "scored": pa.array([*[0] * len(at), scored], pa.int64()),
                })
                waiting.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["side"] == 0:
                    yield from out()
                    block = block_from(row)
                else:
                    waiting.append((row["query_id"], row["query_hash"], row["q"], row["least"]))
        yield from out()

    return met.mapInArrow(run, HITS)


def to_visit(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, query_hash, block) of the blocks but the first that may hold a score of ``least`` or more, by the blocks' bounds."""
    n, n_blocks = queries.count(), blocks.count()
    groups, chunks = max(1, -(-n // GROUP)), max(1, -(-n_blocks // BOUNDS))
    asked = queries.select(F.pmod(F.xxhash64("query_id", "query_hash"), F.lit(groups)).alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("side"), "dims", "block", "query_id", "query_hash", "least", "q")

    told = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("side"), "dims", "block", "low", "high", "mean", "radius")
    met = told.unionByName(asked, allowMissingColumns=True).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "dims", "side", "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, matrix = None, [], None
        for batch in batches:
            found: dict[str, list] = {"query_id": [], "query_hash": [], "block": []}
            for r in batch.to_pylist():
                if (r["grp"], r["chunk"], r["dims"]) != key:
                    key, held, matrix = (r["grp"], r["chunk"], r["dims"]), [], None
                if r["side"] == 0:
                    held.append((r["block"], *(np.frombuffer(r[c], np.float64) for c in ("low", "high", "mean")), r["radius"]))
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix = [np.stack([h[k] for h in held]) for k in (1, 2, 3)] + [np.array([h[4] for h in held]), np.array([h[0] for h in held])]
                low, high, mean, radius, numbers = matrix
                q = np.array(r["q"], np.float64)
                box, ball = high @ np.maximum(q, 0) + low @ np.minimum(q, 0), mean @ q + radius * np.sqrt(q @ q)
                bound = np.minimum(box + np.abs(box) * (SLACK - 1), ball + (np.abs(ball) + radius * np.sqrt(q @ q)) * (SLACK - 1)) + 1
                visit = numbers[(bound >= r["least"]) & (numbers != r["block"])].tolist()
                found["query_id"] += [r["query_id"]] * len(visit)
                found["query_hash"] += [r["query_hash"]] * len(visit)
                found["block"] += visit
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in found.items()})

    return met.mapInArrow(run, "query_id long, query_hash long, block long")


def _best(hits: DataFrame) -> DataFrame:
    rank = F.row_number().over(Win.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id"))
    return hits.where("vec_id is not null").withColumn("rank", rank).where(F.col("rank") <= K)


def all_hits(vectors: DataFrame, is_query) -> DataFrame:
    """HITS of all queries, rows of ``vectors`` where ``is_query``, in all blocks that they visit."""
    rows = materialize(celled(materialize(quantized(vectors), "vectors")), "cells")
    blocks = materialize(blocks_of(rows), "blocks")

    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [int.from_bytes(hashlib.blake2b(np.array(q, np.int64).tobytes(), digest_size=8).digest(), "big", signed=True) for q in batch.column("q").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64())], [*batch.schema.names, "query_hash"])

    queries = rows.where(is_query).distinct().mapInArrow(key, "vec_id long, q array<long>, dims int, cell int, query_hash long").withColumnRenamed("vec_id", "query_id")
    first = blocks.groupBy("dims", "cell").agg(F.min("block").alias("block"))
    begun = materialize(queries.join(first, ["dims", "cell"]).withColumn("least", F.lit(NONE)), "queries")
    near = materialize(search(begun, blocks), "near-hits")
    kth = _best(near).where(F.col("rank") == K).select("query_id", "query_hash", F.col("score").alias("kth"))
    known = begun.join(kth, ["query_id", "query_hash"], "left").withColumn("least", F.coalesce("kth", "least")).drop("kth")
    known = materialize(known, "bounded-queries")
    far = to_visit(known, blocks).join(known.select("query_id", "query_hash", "q", "least"), ["query_id", "query_hash"])
    return near.unionByName(search(materialize(far, "visits"), blocks))


def top_k(vectors: DataFrame, is_query) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector where ``is_query``, the K best of all others."""
    return _best(all_hits(vectors, is_query)).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0)


#: The same result, scored in full.
ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {QUERY_EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= {K}"""
