"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus is encoded in slices of ``SLICE_BYTES``, as the distinct pieces of all of it
would have to be joined back to every place they have; what a worker knows of pieces
it keeps from slice to slice.  A slice is split by the tokenizer's pattern; its distinct pieces
stand in one flat array of byte tokens.  An inverted index from the rank of a
token pair to the positions that have it is walked in rank order: all occurrences
of a pair, in all pieces, are merged at once in numpy, and only their left and
right neighbours get new pairs.  The pieces' ids are then gathered for each text.

Defined cases: a null text is the empty text (no ids); a very long text makes a
slice of its own; equal rows get equal ids; an empty table gives an empty result;
other columns are passed on, and those named like a result are replaced.
The tokens are bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from auspex.llm import words as W
from auspex.llm.rows import carried, tidied

#: Texts of so many bytes are encoded together.
SLICE_BYTES = 4 << 20
#: Bytes of pieces, each with PIECE_BYTES more, whose ids a Python worker keeps from one slice to the next.
CACHE_BYTES, PIECE_BYTES = 24 << 20, 120
NO_RANK = np.int32(2**31 - 1)


class Ranks:
    """A vocabulary: tokens by id, and the id that a pair of ids merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.token_array = pa.array(tokens, pa.binary())
        self.decimal = pa.array([str(i) for i in range(len(tokens))], pa.string())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK for one that no token has."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], NO_RANK)

    def pair(self, left: int, right: int) -> int | None:
        """The rank of one pair."""
        at = int(self.keys.searchsorted(wanted := left << 32 | right))
        return int(self.made[at]) if at < len(self.keys) and self.keys[at] == wanted else None


@functools.lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


@functools.lru_cache(maxsize=2)
def splitter(pattern: str):
    r"""The pattern with \s and \S as Unicode white space, which the tokenizer library's engine means."""
    import regex

    pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return regex.compile(pattern).findall


def replay(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, flat, and the number of each piece's."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    tok = ranks.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(tok)
    last = np.zeros(n, bool)
    last[np.cumsum(sizes[sizes > 0]) - 1] = True
    nxt = np.where(last, -1, np.arange(1, n + 1))
    prv = np.full(n, -1)
    prv[1:] = np.where(last[:-1], -1, np.arange(n - 1))
    current = np.full(n, NO_RANK, np.int32)  # rank of the pair that begins here
    inner = np.flatnonzero(~last)
    current[inner] = ranks.rank(tok[inner], tok[inner + 1])
    index: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []
    odd: list[np.ndarray] = []  # a lower rank came up: such a piece is encoded by itself

    def enter(at: np.ndarray, rank: int) -> None:
        found = current[at]
        at, found = at[found != NO_RANK], found[found != NO_RANK]
        if not len(at):
            return
        if found.min() < rank:
            odd.append(at[found < rank])
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for r, group in zip(found[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if r not in index:
                heapq.heappush(heap, r)
            index[r].append(group)

    enter(inner, -1)
    while heap:
        rank = heapq.heappop(heap)
        groups = index.pop(rank)
        at = groups[0] if len(groups) == 1 else np.concatenate(groups)
        at = at[current[at] == rank]
        if len(at) > 1:
            at.sort()
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            # of overlapping ones (x x x) the first, third, ... are merged
            follows = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
            if follows.any():
                run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        tok[at], tok[gone], nxt[at] = rank, -1, after
        current[gone] = current[at] = NO_RANK
        open_ = after >= 0
        prv[after[open_]] = at[open_]
        left = prv[at]
        touched = np.concatenate([at[open_], left[left >= 0]])
        current[touched] = ranks.rank(tok[touched], tok[nxt[touched]])
        enter(touched, rank)
    kept = tok >= 0
    if odd:
        return _with_single(pieces, sizes, tok, kept, np.concatenate(odd), ranks)
    return tok[kept], _sums(kept, sizes)


def _sums(kept: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.diff(W.prefix(kept)[np.concatenate([[0], np.cumsum(sizes)])])


def _with_single(pieces, sizes, tok, kept, odd, ranks):
    starts = np.concatenate([[0], np.cumsum(sizes)])
    of = np.searchsorted(starts, odd, "right") - 1
    for k in np.unique(of).tolist():
        ids = merge_one(pieces[k], ranks)
        tok[starts[k] : starts[k + 1]] = -1
        tok[starts[k] : starts[k] + len(ids)] = ids
    kept = tok >= 0
    return tok[kept], _sums(kept, sizes)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """The ids of one piece: the leftmost pair of the least rank is merged until none is left, by a heap of pairs."""
    ids = [int(ranks.of_byte[b]) for b in piece]
    n = len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(r, k) for k in range(n - 1) if (r := ranks.pair(ids[k], ids[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        j = after[k]
        if not alive[k] or j < 0 or ranks.pair(ids[k], ids[j]) != rank:
            continue  # one of the pair was merged meanwhile
        ids[k], alive[j], after[k] = rank, False, after[j]
        if after[k] >= 0:
            before[after[k]] = k
        for left in (before[k], k):
            if left >= 0 and after[left] >= 0 and (r := ranks.pair(ids[left], ids[after[left]])) is not None:
                heapq.heappush(heap, (r, left))
    return [x for x, a in zip(ids, alive, strict=True) if a]


class Numbers(dict):
    """Numbers pieces as they come; ``new`` holds those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.bytes = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        self.bytes += len(piece) + PIECE_BYTES
        return number


class Encoder:
    """Encodes slices; ids of pieces seen are kept, a bounded number of them."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split = ranks_of(path), splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        if self.known.bytes > CACHE_BYTES:
            self.forget()
        known = self.known
        per_text, numbers = [], []
        for text in texts:
            found = self.split(text.as_py() or "")
            per_text.append(len(found))
            numbers.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
        if known.new:
            flat, counts = replay([p.encode() for p in known.new], self.ranks)
            known.new = []
            self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        of_piece = np.concatenate([*numbers, np.zeros(0, np.int32)])
        counts = self.counts[of_piece]
        begin = W.prefix(self.counts)[of_piece]
        at = W.prefix(counts)
        ids = self.flat[np.repeat(begin - at[:-1], counts) + np.arange(at[-1])]
        offsets = at[W.prefix(np.array(per_text, np.int64))]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def decode(ids: pa.Array, path: str) -> pa.Array:
    """The bytes of each list of ids."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    tokens = ranks_of(path).token_array.take(ids.flatten())
    offsets = pc.subtract(ids.offsets, ids.offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), pa.scalar(b"", pa.binary()))


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of ``text``, a list of ints; a column of that name is replaced.

    Without ``keep_text`` the ids come in place of the text, which then isn't sent back by the workers.
    """
    keep = carried(docs, out) if keep_text else carried(docs, out, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for part in W.slices(batches, text, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), enc.encode(part.column(text))], [*keep, out])

    # the text must reach the worker even if it is replaced by the ids
    source = docs.select(*keep, text) if text not in keep else docs.select(keep)
    return source.mapInArrow(tidied(run), T.StructType([*docs.select(keep).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def with_digests(encoded: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Number of ids, digest of the ids and of the decoded bytes in place of ``ids``."""
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    keep = carried(encoded, ids, *new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = ranks_of(path).decimal
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                column = part.column(ids)
                offsets = pc.subtract(column.offsets, column.offsets[0])
                written = pc.binary_join(pa.ListArray.from_arrays(offsets, decimal.take(column.flatten())), " ")
                sha = lambda texts: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pc.list_value_length(column).cast(pa.int64()), sha(written), sha(decode(column, path))], [*keep, *new])

    types = (T.LongType(), T.StringType(), T.StringType())
    return encoded.mapInArrow(tidied(run), T.StructType([*encoded.select(keep).schema.fields, *(T.StructField(n, t) for n, t in zip(new, types, strict=True))]))


def byte_bpe_50k() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = byte_bpe_50k()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = with_ids(docs, path, pattern, keep_text=False)
    return with_digests(encoded, path)
