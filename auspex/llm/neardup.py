"""N-gram Jaccard join: MinHash LSH forest with exact verification.

Documents whose sets of word 5-grams are equal are one class.  The signature of a
class gives each of ``TREES`` trees a label of ``LABEL`` hashes; in a tree, classes
sorted by label form a prefix trie.

1. Classes that share a node with another one at the least depth are dealt by that
   node and sorted by label; the trie is walked from whole labels upwards.  Below a
   node, a class much like a leader follows it and stops there: whoever meets the
   class under a shorter prefix meets its leader too, so the class has its recall.
   Classes without one go on under a prefix that is one hash shorter, until a pair at
   the threshold has met in some tree with ``TARGET_RECALL``.  Leaders are tied to
   the leaders that a partner of theirs could follow.
2. The ties' components hold all candidate pairs.  Each is verified exactly: the
   5-grams of its classes, made once and kept as a table, meet in a task for each two
   blocks of it.  A task puts out the number of links of each class and a spanning
   tie, never the pairs.
3. The components of the verified ties are the near-duplicate classes.

A node of more than ``NODE_ROWS`` classes is walked in parts of about that size, and
the leaders of its parts meet in tasks for each two blocks of them, under the same
rule.  Rows of very frequent sets don't move (``join_keyed``).

Defined cases: a text with fewer than five words is one 5-gram, all its words; a
null text, an empty one and one without words have the empty set, and those are
copies of each other; a null doc_id comes last when the smallest is chosen; equal
rows are one class, of which ``keep_one`` keeps one; a very long text is one slice
of its task's work, and its hashes (8 bytes a word) are held at once; an empty table
gives an empty result; extra columns take no part and are carried by ``keep_one``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.llm import words as W
from auspex.llm.rows import identity, own_names, tidied
from auspex.operators.components import components
from auspex.sources.shared import discard, join_keyed, materialize

SHINGLE = 5
THRESHOLD = 0.8
TREES, LABEL = 20, 7
TARGET_RECALL = 0.999
#: By signature: a class this like a leader follows it.
LEADER = 0.8
#: Leaders this alike are tied: partners at distance 0.2, each at 0.2 from its leader, have leaders at 0.6 at most; the rest is for the estimate's error.
TIE = 0.3
#: Classes below a node that one task compares.
NODE_ROWS = 4096
#: Classes of a component in a block.
BLOCK = 512

HASHES = TREES * LABEL
_A = W.mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = W.mix64(np.arange(1001, HASHES + 1001, dtype=np.uint64))


def depth() -> int:
    """The longest prefix with the target recall for a pair at the threshold."""
    d = LABEL
    while d > 1 and 1 - (1 - THRESHOLD**d) ** TREES < TARGET_RECALL:
        d -= 1
    return d


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted in each, and the n + 1 offsets of texts in them."""
    w = W.find_words(texts)
    n_words = np.diff(w.first)
    hashes = w.hashes()
    text_of = w.text_of
    five = W.rolling(hashes, SHINGLE)
    full = np.flatnonzero(W.full_windows(w.first, SHINGLE))
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    own = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        has = n_words[short] > k
        own[has] = W.mix64(own[has] + hashes[w.first[short[has]] + k])
    keys, of = np.concatenate([W.mix64(five[full]), own]), np.concatenate([text_of[full], short])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    keys, of = keys[new], of[new]
    return keys, np.searchsorted(of, np.arange(w.n_texts + 1))


def set_keys(keys: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of each set: sums over its elements."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix64(keys ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    halves = np.stack([W.mix64(s[at[1:]] - s[at[:-1]] + np.diff(at).astype(np.uint64)) for s in sums], 1)
    return [row.tobytes() for row in halves]


def signatures(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values (texts x HASHES, big-endian 32 bits); all ones for the empty set."""
    out = np.full((len(at) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat(((keys * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), at[some])
    return out.astype(">u4")


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, ``row`` (identity of id and text), ``set`` (of shingles), ``sig``, its hashes' low bytes as ``sketch``, and n_shingles of each document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identity("doc_id", text).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            keys, at = shingles(part.column("text"))
            sig = signatures(keys, at)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "row": part.column("row"), "set": pa.array(set_keys(keys, at), pa.binary()), "sig": pa.array([s.tobytes() for s in sig], pa.binary()), "sketch": pa.array([s.tobytes() for s in (sig & 0xFF).astype(np.uint8)], pa.binary()), "n_shingles": np.diff(at).astype(np.int64)})

    return slim.mapInArrow(tidied(run), "doc_id long, row binary, set binary, sig binary, sketch binary, n_shingles long")


def classes_of(rows: DataFrame) -> DataFrame:
    """A row per distinct set, with the representative: the row of the smallest doc_id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("rep")
    return rows.groupBy("set").agg(first, F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_rows"))


def _groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, which come one after the other."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        values = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        first = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or values[k] != values[first]:
                if held and values[first] != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = values[first]
                held.append(batch.slice(first, k - first))
                first = k
    if held:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, column: str, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind).reshape(-1, width)


def _find(root: list[int], k: int) -> int:
    while root[k] != k:
        root[k] = k = root[root[k]]
    return k


def _tie(root: list[int], a: int, b: int) -> None:
    a, b = _find(root, a), _find(root, b)
    root[max(a, b)] = min(a, b)


def walk(labels: np.ndarray, sketch: np.ndarray, floor: int) -> tuple[np.ndarray, list[int]]:
    """Which classes of a trie (sorted labels) are leaders in the end, and a class that each is tied to (root of a forest of ties)."""
    n = len(labels)
    common = np.concatenate([[0], np.cumprod(labels[1:] == labels[:-1], 1).sum(1)])  # hashes that a label shares with the one before
    root, leads, followed = list(range(n)), np.ones(n, bool), np.zeros(n, bool)
    child = np.arange(n)
    for depth_ in range(labels.shape[1], floor - 1, -1):
        node = np.cumsum(common < depth_)
        open_ = np.flatnonzero(leads)
        cuts = np.flatnonzero(np.diff(node[open_])) + 1
        for below in np.split(open_, cuts):
            if len(below) < 2 or child[below[0]] == child[below[-1]]:
                continue
            met: list[int] = []
            for k in below.tolist():
                if met:
                    alike = (sketch[met] == sketch[k]).mean(1)
                    alike[child[met] == child[k]] = 0.0  # those of one child have met below
                    best = int(alike.argmax())
                    if alike[best] >= LEADER and not followed[k]:
                        leads[k], followed[met[best]] = False, True
                        _tie(root, k, met[best])
                        continue
                    for j in np.flatnonzero(alike >= TIE).tolist():
                        _tie(root, k, met[j])
                met.append(k)
        child = node
    return leads, root


TIED = "a binary, b binary, prefix long, leads boolean"


class _Rows:
    """Rows of TIED, put out in batches."""

    def __init__(self):
        self.rows: list[tuple[bytes, bytes, int, bool]] = []

    def add(self, sets: list[bytes], root: list[int], prefix: int, leads: np.ndarray) -> None:
        least: dict[int, bytes] = {}
        for k, s in enumerate(sets):
            r = _find(root, k)
            least[r] = min(least.get(r, s), s)
        self.rows += [(s, least[_find(root, k)], prefix, bool(leads[k])) for k, s in enumerate(sets)]

    def batch(self) -> pa.RecordBatch:
        types = (pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], t) for k, t in enumerate(types)], ["a", "b", "prefix", "leads"])
        self.rows.clear()
        return out


def ties(members: DataFrame, floor: int) -> DataFrame:
    """TIED for each class below each node of the least depth (or a part of it): b is the least class it is tied to."""
    by = ["prefix", "part"]
    dealt = members.repartition(*by).sortWithinPartitions(*by, "label", "set")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for group in _groups(batches, by):
            leads, root = walk(_matrix(group, "label", ">u4", LABEL), _matrix(group, "sketch", "u1", HASHES), floor)
            out.add(group.column("set").to_pylist(), root, group.column("prefix")[0].as_py(), leads)
            if len(out.rows) > 20_000:
                yield out.batch()
        yield out.batch()

    return dealt.mapInArrow(tidied(run), TIED)


def leader_ties(leaders: DataFrame, node_rows: int) -> DataFrame:
    """TIED for the leaders (prefix, set, sketch) of nodes that were walked in parts; they meet in blocks, two in a task."""
    counts = leaders.groupBy("prefix").agg(F.ceil(F.count("*") / node_rows).alias("parts"))
    placed = leaders.join(counts, "prefix").withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    by = ["prefix", "i", "j"]
    dealt = placed.select("prefix", "set", "sketch", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).repartition(*by).sortWithinPartitions(*by, "set")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for group in _groups(batches, by):
            sketch = _matrix(group, "sketch", "u1", HASHES)
            root = list(range(len(sketch)))
            for k in range(1, len(sketch)):
                for j in np.flatnonzero((sketch[:k] == sketch[k]).mean(1) >= TIE).tolist():
                    _tie(root, k, j)
            out.add(group.column("set").to_pylist(), root, group.column("prefix")[0].as_py(), np.ones(len(sketch), bool))
            yield out.batch()

    return dealt.mapInArrow(tidied(run), TIED)


def candidate_groups(classes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """node (a set), root of all classes that may have a partner."""
    floor = depth()
    prefixes = F.array(*(F.xxhash64(F.lit(t), F.substring("sig", 1 + 4 * LABEL * t, 4 * floor)) for t in range(TREES)))
    entries = classes.where("n_shingles > 0").select("set", F.posexplode(prefixes).alias("tree", "prefix"))
    shared = entries.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    below = entries.join(shared, "prefix").join(classes.select("set", "sig", "sketch"), "set")
    label = F.expr(f"substring(sig, 1 + {4 * LABEL} * tree, {4 * LABEL})")
    parts = F.ceil(F.col("n") / node_rows)
    members = materialize(below.select("prefix", "set", "sketch", label.alias("label"), F.pmod(F.xxhash64("set"), parts).alias("part"), (parts > 1).alias("large")), "forest")
    tied = materialize(ties(members, floor), "ties")
    leaders = tied.where("leads").select("prefix", F.col("a").alias("set")).join(members.where("large"), ["prefix", "set"]).select("prefix", "set", "sketch")
    groups = components(tied.unionByName(leader_ties(leaders, node_rows)).select("a", "b"))
    discard(members, tied)  # components are tables of their own
    return groups


def link_matrix(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of THRESHOLD or more, exactly."""
    n, sizes = len(at) - 1, np.diff(at)
    of = np.repeat(np.arange(n), sizes)
    distinct, number = np.unique(keys, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    order = np.argsort(number, kind="stable")
    number, of = number[order], of[order]
    step = 1 << 14
    for first in range(0, len(distinct), step):
        a, b = np.searchsorted(number, [first, first + step])
        has = np.zeros((n, step), np.float32)
        has[of[a:b], number[a:b] - first] = 1
        common += has @ has.T
    both = common.astype(np.int64)
    joint = sizes[:, None] + sizes[None, :] - both
    links = both * 10 >= joint * round(10 * THRESHOLD)
    np.fill_diagonal(links, False)
    return links


def _spanning(links: np.ndarray) -> np.ndarray:
    """For each row the least row of its component."""
    label = np.arange(len(links))
    while True:
        best = np.minimum(label, np.where(links, label[None, :], len(label)).min(1, initial=len(label)))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def verified(groups: DataFrame, classes: DataFrame, docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(a, b, n) for each class in a group: a tie to the least class it is connected with, and its links there."""
    size = groups.groupBy("root").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / block)
    members = groups.join(size.where("n > 1"), "root").join(classes.select(F.col("set").alias("node"), F.col("rep.row").alias("row")), "node")
    members = members.select("node", "root", "row", F.pmod(F.xxhash64("node"), parts).alias("own"), parts.alias("parts"))
    texts = docs.select(identity("doc_id", text).alias("row"), F.col(text).alias("text"))

    def hash_(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            keys, at = shingles(part.column("text"))
            rest = [part.column(c) for c in ("node", "root", "own", "parts")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([keys[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["node", "root", "own", "parts", "keys"])

    sets = materialize(texts.join(members, "row").select("node", "root", "own", "parts", "text").mapInArrow(tidied(hash_), "node binary, root binary, own long, parts long, keys binary"), "shingles")
    by = ["root", "i", "j"]
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "keys").repartition(*by).sortWithinPartitions(*by, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, by):
            nodes = group.column("node").to_pylist()
            one = [k for k in range(len(nodes)) if k == 0 or nodes[k] != nodes[k - 1]]  # equal rows come twice
            group = group.take(pa.array(one))
            nodes, own = [nodes[k] for k in one], group.column("own").to_numpy()
            each = [np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()]
            links = link_matrix(np.concatenate(each), W.prefix(np.array(list(map(len, each)))))
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                links &= own[:, None] != own[None, :]  # pairs in one block have a task of their own
            root, count = _spanning(links), links.sum(1)
            some = np.flatnonzero(count).tolist()
            yield pa.RecordBatch.from_pydict({"a": pa.array([nodes[k] for k in some], pa.binary()), "b": pa.array([nodes[root[k]] for k in some], pa.binary()), "n": pa.array(count[some], pa.int64())})

    return met.mapInArrow(tidied(run), "a binary, b binary, n long")


def _near(docs: DataFrame, text: str, node_rows: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Tables: the documents with their sets, and each set (n_rows documents) with copy_of, the class's first document ``of`` and n_links."""
    rows = materialize(hashed(docs, text), "sets")
    classes = materialize(classes_of(rows), "classes")
    found = materialize(verified(candidate_groups(classes, node_rows), classes, docs, text, block), "links")
    links = found.groupBy(F.col("a").alias("set")).agg(F.sum("n").alias("n_links"))
    near = components(found.select("a", "b")).withColumnRenamed("node", "set")
    reps = classes.select("set", "rep", "n_rows")
    least = near.join(reps, "set").groupBy("root").agg(F.min("rep").alias("class_rep"))
    known = near.join(least, "root").join(links, "set", "left").select("set", "class_rep", "n_links")
    full = reps.join(known, "set", "left").select("set", "n_rows", F.col("rep.doc_id").alias("copy_of"), F.coalesce("class_rep", "rep").alias("of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    full = materialize(full, "near")
    discard(classes, found)
    return rows, full


def near_duplicates(docs: DataFrame, text: str = "text", node_rows: int = NODE_ROWS, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, row, copy_of (smallest id with its set), class_id and class_row (smallest id
    of its near-duplicate class, and that row), n_links (other sets with a similarity of THRESHOLD or more)."""
    rows, full = _near(docs, text, node_rows, block)
    placed = join_keyed(rows.select("doc_id", "row", "set"), full, "set", "n_rows")
    return placed.select("doc_id", "row", "copy_of", F.col("of.doc_id").alias("class_id"), F.col("of.row").alias("class_row"), "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id, with the columns of ``docs``."""
    rows, full = _near(docs, "text", NODE_ROWS, BLOCK)
    reps = materialize(full.select(F.col("of.row").alias("_row")).distinct(), "kept")
    discard(rows, full)
    own = own_names(docs)
    kept = docs.withColumnsRenamed(own).withColumn("_row", identity(F.col(f"`{own['doc_id']}`"), F.col(f"`{own['text']}`"))).join(reps, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.select(*(F.col(f"`{name}`").alias(c) for c, name in own.items()))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "copy_of", "n_links")
