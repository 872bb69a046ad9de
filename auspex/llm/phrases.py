r"""Phrase collocation mining over vertical positional inverted lists.

Texts are cut in blocks.  In a block, each word has the sorted list of its positions;
pieces are told apart by a gap in the positions.  A frequent phrase is extended by
a merge-join of its occurrence positions with the postings of the adjacent word.
A word's postings are kept apart by the frequent phrase of the same length that the
word ends there, so extensions whose tail is rare are never made, and the pair (id of
the phrase without its last word, id of the phrase without its first) names the
extension exactly.  The length of a list is the exact frequency in its block.

A level's lists are a table, a row for each block.  Frequencies are sums over
blocks, so each block deals its keys, with the lengths and numbers of their lists, into
buckets of bounded size, packed: a row for each block and bucket.  A bucket is counted at
once, and what is frequent in it gets ids, which go back to the blocks, a row for each
bucket and block.  No row is made for a key of a block.  No task holds a phrase's
occurrences in all blocks, no driver a list.

Frequencies of a phrase's first and last parts come along its chain of ids, so
scores need joins of frequent phrases only.  Scores and shares are decimals.  The ranks
of a group are running sums over range-sorted rows.

Defined cases: null texts and texts without words have no phrases; a null group is
``und`` and one with the group of that name; a very long text is a block of its own;
equal rows all count; ties of score go to the larger frequency, then to the phrase that
is smaller in UTF-8; an empty table gives an empty result; extra columns take no part,
whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.llm import words as W
from auspex.llm.rows import running_sum, tidied
from auspex.sources.shared import discard, materialize

MIN_COUNT = 30
MAX_WORDS = 4
#: A phrase goes if a longer one has so many percent of its occurrences.
INSIDE_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
#: Bytes of texts in a block, about.
BLOCK_BYTES = 2 << 20
#: Frequent phrases of a level whose ids are broadcast to the phrases before them at most (32 bytes each).
BROADCAST_ROWS = 1_000_000
#: Keys of all blocks in a bucket, about (under 30 bytes each).
BUCKET = 1 << 19
#: Blocks in a task that extends phrases, about: their number grows with the input, what a task holds doesn't.
TASK_BLOCKS = 4

_PIECE_END = np.zeros(256, bool)
_PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_BETWEEN = _PIECE_END.copy()
_BETWEEN[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def positioned(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Every word of a slice of texts, lower-cased, its text's number and its position: that of the word before plus one in a piece, plus two across pieces."""
    data, at = W.text_buffer(texts)
    inside = ~_BETWEEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside])
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    letters = _LOWER[data[inside]]
    offsets = W.prefix(ends - starts)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    # grows with each end of a piece or text before the word
    place = np.searchsorted(np.flatnonzero(_PIECE_END[data]), starts) + np.searchsorted(at, starts, "right")
    apart = np.concatenate([[False], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    return words, np.searchsorted(at, starts, "right") - 1, (np.arange(len(starts)) + np.cumsum(apart)).astype(np.int64)


def grouped(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the lengths of their lists, and the lists one after the other, each ascending as ``positions`` are."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.diff(np.concatenate([begin, [len(keys)]])), positions[order]


#: A row for each block: its words, or phrases by their two ids, with the lengths of their lists; the lists, int32, one after the other.
WORD_LISTS = "block long, grp array<string>, word array<string>, n array<int>, lists binary"
PHRASE_LISTS = "block long, head array<long>, tail array<long>, n array<int>, lists binary"


def word_lists(docs: DataFrame, text: str, group: str) -> DataFrame:
    """WORD_LISTS of ``docs``."""
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("grp"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part in W.slices(batches, "text", BLOCK_BYTES):
            words, of, position = positioned(part.column("text"))
            if not len(words):
                continue
            names, groups = words.dictionary_encode(), part.column("grp").dictionary_encode()
            n_words = len(names.dictionary)
            keys, n, lists = grouped(groups.indices.to_numpy()[of].astype(np.int64) * n_words + names.indices.to_numpy(), position)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), one(groups.dictionary.take(pa.array(keys // n_words)), pa.string()), one(names.dictionary.take(pa.array(keys % n_words)), pa.string()),
                one(pa.array(n), pa.int32()), pa.array([lists.astype(np.int32).tobytes()], pa.binary()),
            ], ["block", "grp", "word", "n", "lists"])
            block += 1

    return rows.mapInArrow(tidied(run), WORD_LISTS)


def phrase_lists(level: DataFrame, kept: DataFrame) -> DataFrame:
    """PHRASE_LISTS of the phrases a word longer than those of ``level``, from its frequent ones: ``kept`` has their places in each block.

    A block's lists come before its rows of ``kept``, which are read a batch at a time.
    """
    lists = level.select("block", F.lit(-1).alias("at"), "n", "lists")
    rows = kept.unionByName(lists, allowMissingColumns=True)
    parts = max(int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-level.count() // TASK_BLOCKS))
    dealt = rows.repartition(parts, "block").sortWithinPartitions("block", "at")

    def made(lists: pa.RecordBatch, kept: list[bytes]) -> Iterator[pa.RecordBatch]:
        at, id_ = (np.concatenate(k) for k in zip(*map(unpacked, kept), strict=True)) if kept else (np.zeros(0, np.int64),) * 2
        found = extended(at, id_, lists.column("n")[0].values.to_numpy(zero_copy_only=False), np.frombuffer(lists.column("lists")[0].as_buffer(), np.int32)) if len(at) else None
        if found is not None:
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            head, tail, n, lists_ = found
            yield pa.RecordBatch.from_arrays([lists.column("block"), one(head, pa.int64()), one(tail, pa.int64()), one(n, pa.int32()), pa.array([lists_.tobytes()], pa.binary())], ["block", "head", "tail", "n", "lists"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, held = None, []
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in itertools.pairwise([0, *edges.tolist(), len(block)] if len(block) else []):
                if batch.column("at")[lo].as_py() < 0:
                    if lists is not None:
                        yield from made(lists, held)
                    lists, held, lo = batch.slice(lo, 1), [], lo + 1
                held += batch.column("places").slice(lo, hi - lo).to_pylist()
        if lists is not None:
            yield from made(lists, held)

    return dealt.mapInArrow(tidied(run), PHRASE_LISTS)


def extended(at: np.ndarray, id_: np.ndarray, n: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Heads, tails, lengths and lists of the phrases that the frequent ones ``at`` are extended to; None if there are none."""
    order = np.argsort(at)
    at, id_ = at[order], id_[order]
    frequent = np.zeros(len(n), bool)
    frequent[at] = True
    occurrences, of = lists[np.repeat(frequent, n)], np.repeat(np.arange(len(at), dtype=np.int64), n[at])
    order = np.argsort(occurrences, kind="stable")
    occurrences, of = occurrences[order], of[order]  # all lists, merged by position
    # the adjacent word ends a phrase that begins one position later
    met = np.flatnonzero(occurrences[1:] == occurrences[:-1] + 1)
    if not len(met):
        return None
    pairs, n, lists = grouped(of[met] * len(at) + of[met + 1], occurrences[met])
    return id_[pairs // len(at)], id_[pairs % len(at)], n, lists


def keys_schema(key: list[str]) -> pa.Schema:
    """A block's keys in a bucket: with the lengths of their lists and their places in the block."""
    return pa.schema([*((k, pa.string() if k in ("grp", "word") else pa.int64()) for k in key), ("n", pa.int32()), ("at", pa.int32())])


def hashed(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a column of strings or longs."""
    if pa.types.is_integer(column.type):
        return W.mix64(column.to_numpy(zero_copy_only=False).astype(np.uint64))
    data, at = W.text_buffer(column)
    return W.span_hashes(data, at[:-1], at[1:])


def joint(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row of two columns: equal rows have equal ones, others don't."""
    numbers = []
    for c in columns:
        v = c.to_numpy() if pa.types.is_integer(c.type) else c.dictionary_encode().indices.to_numpy()
        if len(v) and v.max() >> 31:
            v = np.unique(v, return_inverse=True)[1]
        numbers.append(v.astype(np.int64))
    return numbers[0] << 32 | numbers[1]


def unpacked(places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places (at) and ids of the frequent ones of a block in a bucket."""
    n = len(places) // 12
    return np.frombuffer(places, np.int32, n).astype(np.int64), np.frombuffer(places, np.int64, n, 4 * n)


def bucket_keys(level: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """bucket, block and the packed keys of the block that fall in the bucket."""
    schema = keys_schema(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                columns = [batch.column(c)[row].values for c in (*key, "n")]
                h = np.zeros(len(columns[0]), np.uint64)
                for c in columns[:-1]:
                    h = W.mix64(h + hashed(c))
                bucket = (h % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable").astype(np.int32)
                at = pa.array(order)
                packed = pa.RecordBatch.from_arrays([*(c.take(at).cast(f.type) for c, f in zip(columns, schema)), at], schema=schema)
                some, first = np.unique(bucket[order], return_index=True)
                keys = [packed.slice(lo, hi - lo).serialize().to_pybytes() for lo, hi in itertools.pairwise([*first.tolist(), len(order)])]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), batch.column("block")[row].as_py(), np.int64)), pa.array(keys, pa.binary())], ["bucket", "block", "keys"])

    return level.select("block", *key, "n").mapInArrow(tidied(run), "bucket int, block long, keys binary")


def frequent(level: DataFrame, key: list[str], least: int) -> DataFrame:
    """``key``, ``f``, the sum of the lists' lengths over all blocks, and a new id, for those of ``least`` or more.

    Further rows, with ``block`` and ``places`` instead, tell where these are among a block's keys.
    """
    total = level.agg(F.sum(F.size("n"))).first()[0] or 0
    buckets = -(-total // BUCKET) or 1
    parts = max(int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    dealt = bucket_keys(level, key, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    schema = keys_schema(key)
    names = [*key, "f", "id", "block", "places"]
    kinds = [*(schema.field(k).type for k in key), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def counted(bucket: int, blocks: list[int], packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        read = [pa.ipc.read_record_batch(pa.py_buffer(p), schema) for p in packed]
        every = pa.Table.from_batches(read).combine_chunks().to_batches()[0]
        numbers = joint([every.column(k) for k in key])
        order = np.argsort(numbers, kind="stable")
        numbers = numbers[order]
        begin = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        f = np.add.reduceat(every.column("n").to_numpy().astype(np.int64)[order], begin)
        kept = f >= least
        ids = np.full(len(begin), -1)
        ids[kept] = bucket + buckets * np.arange(kept.sum(), dtype=np.int64)
        if not kept.any():
            return
        firsts = pa.array(order[begin[kept]])
        yield pa.RecordBatch.from_arrays([*(every.column(k).take(firsts) for k in key), pa.array(f[kept]), pa.array(ids[kept]), pa.nulls(len(firsts), pa.int64()), pa.nulls(len(firsts), pa.binary())], names)
        id_of = np.empty(len(order), np.int64)
        id_of[order] = np.repeat(ids, np.diff(np.concatenate([begin, [len(order)]])))
        at, edges, places = every.column("at").to_numpy(), W.prefix(np.array([r.num_rows for r in read])), []
        for lo, hi in itertools.pairwise(edges.tolist()):
            some = id_of[lo:hi] >= 0
            places.append(at[lo:hi][some].tobytes() + id_of[lo:hi][some].tobytes() if some.any() else None)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(blocks), k) for k in kinds[:-2]), pa.array(blocks, pa.int64()), pa.array(places, pa.binary())], names).filter(pa.array([p is not None for p in places]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, packed = None, [], []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            edges = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in itertools.pairwise([0, *edges.tolist(), len(bucket)] if len(bucket) else []):
                if now is not None and now != bucket[lo]:
                    yield from counted(now, blocks, packed)
                    blocks, packed = [], []
                now = int(bucket[lo])
                blocks += batch.column("block").slice(lo, hi - lo).to_pylist()
                packed += batch.column("keys").slice(lo, hi - lo).to_pylist()
        if now is not None:
            yield from counted(now, blocks, packed)

    kind = "string" if key == ["grp", "word"] else "long"
    return dealt.mapInArrow(tidied(run), f"{', '.join(f'{k} {kind}' for k in key)}, f long, id long, block long, places binary")


def joined_back(level: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Block and packed places and ids of the frequent ones among each block's keys."""
    return found.where("block IS NOT NULL").select("block", F.lit(0).alias("at"), "places")


def levels(docs: DataFrame, text: str, group: str, least: int, most_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """n, the words of each group (grp), and the frequent phrases of 1, 2, ... words.

    A phrase has id, grp, phrase, last (its last word), f, ``first``: the frequencies
    of its first 1, 2, ... words, and ``rest``: those of what these leave.
    """
    lists = materialize(word_lists(docs, text, group), "word-lists")
    every = lists.select(F.inline(F.arrays_zip("grp", "n"))).groupBy("grp").agg(F.sum("n").alias("n"))
    every = materialize(every, "group-words")
    key = ["grp", "word"]
    found = materialize(frequent(lists, key, least), "frequent-words")
    words = found.where("block IS NULL")
    none = F.array().cast("array<long>")
    out = [words.select("id", "grp", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("first"), none.alias("rest"), F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"))]
    for _ in range(1, most_words):
        longer = materialize(phrase_lists(lists, joined_back(lists, found, key)), "phrase-lists")
        discard(lists)
        lists, key = longer, ["head", "tail"]
        found = materialize(frequent(lists, key, least), "frequent-pairs")
        before = out[-1]
        heads = before.select(F.col("id").alias("head"), "grp", F.col("phrase").alias("_p"), F.concat("first", F.array("f")).alias("first"))
        tails = before.select(F.col("id").alias("tail"), "last", F.concat(F.array("f"), "rest").alias("rest"))
        pairs = found.where("block IS NULL").select("head", "tail", "f", "id")
        met = heads.join(F.broadcast(pairs) if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else pairs, "head").join(tails, "tail")
        out.append(materialize(met.select("id", "grp", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", "f", "first", "rest", "head", "tail"), "phrases"))
    discard(lists)
    return every, out


def cut_score(first: str, rest: str, a: str) -> Column:
    """The cut of the lowest score, the first of equal ones: score, k, l and r."""
    wide = lambda c: c.cast("decimal(20,0)")

    def scored(z: Column, k: Column) -> Column:
        all_, sum_ = F.lit(SCALE).cast("decimal(7,0)") * wide(F.col(a)), wide(z["l"]) + wide(z["r"])
        return F.struct(((all_ - all_ % sum_) / sum_).cast("long").alias("score"), (k + 1).alias("k"), z["l"].alias("l"), z["r"].alias("r"))

    return F.array_min(F.transform(F.arrays_zip(F.col(first).alias("l"), F.col(rest).alias("r")), scored))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = MIN_COUNT, most_words: int = MAX_WORDS, inside_percent: int = INSIDE_PERCENT, top: int | None = TOP) -> DataFrame:
    """grp, rank, phrase, a, l, r, n and score of each group's first ``top`` phrases (all without it)."""
    every, phrases = levels(docs, text, group, least, most_words)
    kept = []
    for k, level in enumerate(phrases[1:], 1):
        if k + 1 < len(phrases):
            longer = phrases[k + 1]
            around = longer.select(F.col("head").alias("id"), F.col("f").alias("_f")).unionByName(longer.select(F.col("tail").alias("id"), F.col("f").alias("_f")))
            around = around.groupBy("id").agg(F.max("_f").alias("_f"))
            wide = lambda c, by: F.lit(by).cast("decimal(3,0)") * F.col(c).cast("decimal(20,0)")
            level = level.join(around, "id", "left").where(F.col("_f").isNull() | (wide("_f", 100) < wide("f", inside_percent))).drop("_f")
        kept.append(level.select("grp", "phrase", F.col("f").alias("a"), cut_score("first", "rest", "f").alias("_c")))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("grp", "phrase", "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), F.col("_c.score").alias("score"), (-F.col("_c.score")).alias("_s"), (-F.col("a")).alias("_a"), F.lit(1).cast("long").alias("_one"))
    placed = running_sum(rows, ["grp", "_s", "_a", "phrase"], "_one", "_at")
    firsts = placed.groupBy("grp").agg(F.min("_at").alias("_first")).join(every, "grp")
    ranked = placed.join(firsts, "grp").withColumn("rank", F.col("_at") - F.col("_first") + 1)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("grp", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    return collocations(docs).withColumnRenamed("grp", "lang")


def _grams(k: int) -> str:
    """DuckDB: the phrases of ``k`` words."""
    return f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i : i + {k - 1}], ' '))) AS phrase FROM pieces WHERE len(ws) >= {k}"


#: The same from counts of all phrases.
ORACLE_SQL = f"""
WITH pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({" UNION ALL ".join(_grams(k) for k in range(1, MAX_WORDS + 1))}) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {MIN_COUNT}),
cut AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS j, ws FROM c),
scored AS (SELECT cut.lang, cut.k, cut.phrase, a, j, l.f AS l, r.f AS r, (({SCALE}::HUGEINT * a) // (l.f + r.f))::BIGINT AS score FROM cut
  JOIN f AS l ON l.lang = cut.lang AND l.phrase = array_to_string(ws[1:j], ' ') JOIN f AS r ON r.lang = cut.lang AND r.phrase = array_to_string(ws[j + 1:cut.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, phrase, max(a) AS f FROM (SELECT lang, a, unnest(list_concat({", ".join(f"list_transform(range(1, k - {m - 2}), lambda i: CASE WHEN k > {m} THEN array_to_string(ws[i : i + {m - 1}], ' ') END)" for m in range(2, MAX_WORDS))})) AS phrase FROM c) WHERE phrase IS NOT NULL GROUP BY 1, 2)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE inside.f IS NULL OR 100 * inside.f::HUGEINT < {INSIDE_PERCENT} * a::HUGEINT) JOIN total USING (lang) WHERE rank <= {TOP}"""
