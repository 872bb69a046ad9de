"""Columnar words: a batch of texts as flat numpy arrays.

A word is a run of ``[^\x20\x09-\x0D]``.  The separators are ASCII, so words are
found in the UTF-8 bytes without decoding.  All functions work on a bounded
slice of a batch (``slices``), so memory follows the slice and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 offsets in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = prefix(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
    up[:1] = down[:1] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if n <= SLICE_BYTES + 1:
        _POWERS[:] = [up, down]
    return up, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix64((sums[ends] - sums[starts]) * down[starts] + length * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts
    at: np.ndarray  #: n + 1 offsets of texts in ``data``
    starts: np.ndarray  #: of words, in ``data``
    ends: np.ndarray
    first: np.ndarray  #: n + 1 offsets of texts in the words
    in_word: np.ndarray  #: of each byte

    @property
    def n_texts(self) -> int:
        return len(self.at) - 1

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def per_text(self, of_byte: np.ndarray) -> np.ndarray:
        """Sum over each text's bytes."""
        return prefix(of_byte)[self.at[1:]] - prefix(of_byte)[self.at[:-1]]


def prefix(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def find_words(texts: pa.Array) -> Words:
    data, at = text_buffer(texts)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins or ends here
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, at, starts, stops, np.searchsorted(starts, at), inside)


def rolling(hashes: np.ndarray, n: int, before: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n words from each word on; ``before`` is that of n - 1, else all are made."""
    if before is None:
        out = hashes.copy()
        for k in range(2, n + 1):
            out = rolling(hashes, k, out)
        return out
    out = before * np.uint64(0x2545F4914F6CDD1D)
    out[: max(0, len(out) - n + 1)] += hashes[n - 1 :]
    return out


def full_windows(first: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether n words from it on lie in one text; ``first``: offsets of texts."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return left >= n


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    return again[at] == keys


def prefix_of(x: np.ndarray) -> np.ndarray:
    """Prefix sums of floats, n + 1 of them."""
    return np.concatenate([np.zeros(1), np.cumsum(x)])
