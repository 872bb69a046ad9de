"""Substring dedup: fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: the minimizers of each text's word k-mers, so that two texts which share
   ``K + WINDOW - 1`` words in a row share a seed, and those of its ``LONG_K``-mers,
   so that ``MIN_WORDS`` words in a row share one of these as well.  A text is known by
   its hash; a task puts out the seeds of equal texts once.
2. A seed that several texts have is matched with its places in others, the sources:
   with those of all texts of smaller hash if no more than ``RARE`` texts have it; else
   (a busy seed) with that of the smallest hash, so a frequent passage has one source
   and never all pairs of its texts.  What that leaves is matched by pairs of seeds
   (``pair_matches``): the company of a busy seed in a text are the shared seeds up to
   ``NEAR`` words behind it, without those that its source has there as well.  The
   texts of a busy seed are compared: for each seed of its company that texts of smaller
   hash have in theirs, a text is matched with all of them if they are no more than
   ``RARE``, else with one: the seed's source, or the one that shares most of what is not
   covered yet.  So no
   pair of seeds that a text shares with one of smaller hash is left without a source
   that has both.
3. The matches of a text and a source that overlap on one diagonal are one segment.
   Segments are chained: the best chain of segments that ascend in both, less a cost
   for gaps, comes from a Fenwick tree over the places in the source.  Chains are taken
   from the best on until no segment is left.  A text's sources come in the order of
   the seeds it shares with them; one that only has what sure chains with earlier
   sources have already is passed over.  A chain is sure if its segments alone make a
   passage: it is a result even if its extension would cost it its identity.
4. A chain is aligned: the words between its segments by longest common subsequence,
   its ends are extended over matching words.  Passages of ``MIN_WORDS`` words and
   ``IDENTITY`` and more are results, but for those inside of another one of both texts.

5. What 2 passes over is compared as well (``rest_matches``): a busy seed and its company
   that lie in no passage of their text are compared with those of all texts of smaller
   hash, however many, by the words around them: where they are many, those that share
   pairs of words beside the line that all have.  Those that allow a passage are chained
   and aligned.  Of sources whose words there are the same, one stands for the others.

Very frequent (heavy) seeds aren't dealt by their hash: they are found among the texts
whose hash is in the lowest ``LOW``-th part, which have their sources as well, since
a source is a text of the smallest hash; their matches are made where the texts are
read.  A seed that is missed there is dealt like the others, with the same result.
Pairs of seeds are found for both alike.

Copies of a text are single rows that refer to its smallest doc_id.

Defined cases: null texts, empty ones and those of fewer than MIN_WORDS words have
no passages; a null doc_id comes last when the smallest is chosen; equal rows are
copies of each other; repetition inside a text is no passage; a very long text is one
slice of its task's work and its seeds are held at once; an empty table gives an empty
result; extra columns take no part in the search and are carried by ``cut_documents``,
whatever their names.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auspex.llm import words as W
from auspex.llm.rows import identity, own_names, tidied
from auspex.sources.shared import discard, join_keyed, materialize, swept

K, WINDOW = 5, 4
MIN_WORDS = 40
#: A long seed counts as LONG_K / K seeds; LONG_K + LONG_WINDOW - 1 = MIN_WORDS.
LONG_K, LONG_WINDOW = 30, 11
IDENTITY = 0.8
#: A seed of so many texts is matched with all of them of smaller hash.
RARE = 5
#: Seeds up to so many words behind a busy seed are its company.
NEAR = MIN_WORDS
#: Pairs of texts that are counted at once.
BLOCK = 1 << 20
#: Heavy seeds are one of so many seeds or more, so there are no more of them, and found in the texts of the lowest part of hashes.
HEAVY, LOW, HEAVY_LEAST = 4096, 64, 16
#: A chain is aligned from so many matches and words on.
MIN_SEEDS, MIN_SPAN = 2, 8
#: Words on either side of a busy seed that are compared, and by how many a word may be moved there.
SIDE, DRIFT = 40, 8
#: Same words at both ends of a passage that is certain.
ENDS = 4
#: Places of a busy seed that are compared in one go with as many others.
PART = 32768
#: Of so many pairs of places, all are compared; of more, those with PAIRED word pairs in common beside COMMON words around the seed that many have.
FEW, COMMON, PAIRED = 1 << 13, 20, 2
#: The most frequent word pairs around a place that may be among COMMON words.
FREQUENT = 32
#: Pairs of places that are compared at once.
COMPARED = 4096
#: What a word of a gap costs, in either text; a match is worth its new words.
GAP_COST = 0.1
#: Words around a chain that are fetched for its extension, and the steps of such a request.
PAD, STEP = 40, 32
MISMATCH, DROP = 1.5, 6.0
FALLEN = int(DROP / MISMATCH) + 1
#: Words that an extension may skip in either text.
SKIPS = ((1, 0), (0, 1), (2, 0), (0, 2), (3, 0), (0, 3), (2, 1), (1, 2))


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Which hashes are the least of a window of so many."""
    least = h.copy()
    for k in range(1, window):
        least[:-k] = np.minimum(least[:-k], h[k:])
    most = least.copy()  # of the minima of all windows that have the hash
    for k in range(1, window):
        most[k:] = np.maximum(most[k:], least[:-k])
    return most == h


def seeds(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Hash, text and place (number of the word) of the minimizers of each text; the lowest bit of the hash is 1 for long ones."""
    w = W.find_words(texts)
    top = np.uint64(2**64 - 1)
    text_of = w.text_of
    enough = np.diff(w.first)[text_of] >= MIN_WORDS
    short = W.rolling(w.hashes(), K)
    long = short.copy()
    for k in range(K, LONG_K, K):
        long *= np.uint64(0x2545F4914F6CDD1D)
        long[: max(0, len(long) - k)] += W.mix64(short[k:])
    found = []
    for keys, k, window in ((short, K, WINDOW), (long, LONG_K, LONG_WINDOW)):
        h = np.where(W.full_windows(w.first, k), W.mix64(keys), top)
        chosen = minimizers(h, window) & (h != top) & enough
        at = np.flatnonzero(chosen)
        found.append((h[at] & ~np.uint64(1) | np.uint64(k == LONG_K), at))
    h, at = (np.concatenate(x) for x in zip(*found, strict=True))
    # a run of one word or of a short period has each of its seeds once
    order = np.lexsort((at, h))
    again = np.zeros(len(at), bool)
    again[order[1:]] = (np.diff(h[order]) == 0) & (np.diff(at[order]) < MIN_WORDS) & (np.diff(text_of[at[order]]) == 0)
    h, at = h[~again], at[~again]
    return h.view(np.int64), text_of[at], (at - w.first[text_of[at]]).astype(np.int32)


def new_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Hash and text of the texts of a task's batches (th, text), in slices, equal ones once."""
    done: set[int] = set()
    for part in W.slices(batches, "text"):
        th = part.column("th").to_numpy()
        _, firsts = np.unique(th, return_index=True)
        new = np.array(sorted(k for k in firsts.tolist() if th[k] not in done), np.int64)
        done.update(th[new].tolist())
        yield th[new], part.column("text").take(pa.array(new))


def hashed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("th"), "text")


def heavy_seeds(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hash, source and place there of the heavy seeds, sorted by hash; HEAVY at most; and about how many places all seeds have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, texts in new_texts(batches):
            h, of, pos = seeds(texts)
            yield pa.RecordBatch.from_pydict({"h": h, "th": th[of], "pos": pos})

    low = hashed_texts(docs).where(F.col("th") < -(2**63) + 2**64 // LOW)
    found = materialize(low.mapInArrow(tidied(run), "h long, th long, pos int").groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("th", "pos")).alias("s")), "low-seeds")
    total = found.agg(F.sum("n")).first()[0] or 0
    least = max(HEAVY_LEAST, total / HEAVY)
    rows = sorted((r["h"], r["s"]["th"], r["s"]["pos"]) for r in found.where(F.col("n") >= least).collect())
    discard(found)
    return (*(np.array([r[k] for r in rows], np.int64) for k in range(3)), LOW * total)


#: Hash, text and place of the seeds of a slice of texts in one bucket: int64, int64 and the two halves of int32; places of heavy seeds are inverted (below 0).
SEEDS = "bucket int, h binary, th binary, low binary, high binary"
#: Seeds in a bucket, about, and how many buckets there are at least and at most.
BUCKET, BUCKETS = 1 << 17, (64, 4096)


def looked_up(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash among the ``known`` ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return at, known[at] == h


def seed_table(docs: DataFrame, known: np.ndarray, total: int) -> DataFrame:
    """SEEDS of all texts, about ``total``; the ``known`` ones are heavy and lie in any bucket, all others of a hash in one."""
    buckets = np.uint64(min(BUCKETS[1], max(BUCKETS[0], total // BUCKET)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, texts in new_texts(batches):
            h, of, pos = seeds(texts)
            th, heavy = th[of], looked_up(h, known)[1]
            bucket = (np.where(heavy, W.mix64(th.view(np.uint64) + pos.astype(np.uint64)), h.view(np.uint64) >> np.uint64(20)) % buckets).astype(np.int16)
            order = np.argsort(bucket, kind="stable")
            count = np.bincount(bucket)
            some = np.flatnonzero(count)
            at, pos = W.prefix(count[some]), np.where(heavy, ~pos, pos)[order]

            def cut(x: np.ndarray) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])  # noqa: B023

            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), cut(h[order]), cut(th[order]), cut(pos.astype(np.uint16)), cut((pos >> 16).astype(np.int16))], ["bucket", "h", "th", "low", "high"])

    return hashed_texts(docs).mapInArrow(tidied(run), SEEDS)


def bucket_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hash, text and place (rows of an array) of the seeds of each bucket, sorted, each once; SEEDS come sorted by bucket."""

    def joined(parts: list[pa.RecordBatch]) -> np.ndarray:
        h, th, low, high = (np.frombuffer(b"".join(x for p in parts for x in p.column(c).to_pylist()), kind) for c, kind in (("h", np.int64), ("th", np.int64), ("low", np.uint16), ("high", np.int16)))
        rows = np.stack([h, th, high.astype(np.int64) << 16 | low])
        rows = rows[:, np.lexsort(rows[::-1])]
        return rows[:, changes(rows)]  # equal texts of several tasks once

    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        for lo, hi in itertools.pairwise([*np.flatnonzero(changes(bucket[None])).tolist(), len(bucket)]):
            if held and held[0].column("bucket")[0].as_py() != bucket[lo]:
                yield joined(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield joined(held)


def changes(x: np.ndarray) -> np.ndarray:
    """Which columns differ from the one before."""
    return np.append(np.ones(min(1, x.shape[1]), bool), (np.diff(x) != 0).any(0))


def matched(h: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by seed, text and place: (row, row of the source), for whole seeds; and the number of texts of each row's seed."""
    n = len(h)
    seed = np.ones(n, bool)
    seed[1:] = h[1:] != h[:-1]
    text = seed.copy()
    text[1:] |= th[1:] != th[:-1]
    number = np.cumsum(text) - 1  # of each text of each seed
    first = np.flatnonzero(text)  # its first row
    begin = np.maximum.accumulate(np.where(seed, number, 0))  # the seed's first text
    nth = number - begin
    texts = np.bincount(np.cumsum(seed) - 1, weights=text).astype(np.int64)[np.cumsum(seed) - 1]
    n_sources = np.where(texts <= RARE, nth, np.minimum(nth, 1))
    row = np.repeat(np.arange(n), n_sources)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n_sources) - n_sources, n_sources)
    return row, first[begin[row] + step], texts


def whole(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[np.ndarray]:
    """The columns (integers, sorted by the first) as rows of an array, never cut within a value of the first; nulls are 0."""
    held: list[np.ndarray] = []  # the value that the last batch ended in
    for batch in batches:
        part = np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
        if not part.shape[1]:
            continue
        if held and part[0, -1] == held[0][0, 0]:
            held.append(part)
            continue
        last = int(np.searchsorted(part[0], part[0, -1]))
        if held or last:
            yield np.concatenate([*held, part[:, :last]], 1)
        held = [part[:, last:]]
    if held:
        yield np.concatenate(held, 1)


#: Hash of a seed, its distance and (lowest bit) whether the busy seed's source lacks it there.
PAIR = np.dtype([("key", "<i8"), ("step", "<i4")])
#: A match has no h; a place of a seed that several texts have, no src.
MATCHES = "h long, th long, src long, at long"


def match_rows(th: np.ndarray, src: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(th), pa.int64()), pa.array(th), pa.array(src), pa.array(at)], ["h", "th", "src", "at"])


def matches(seeds_: DataFrame, heavy: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> DataFrame:
    """MATCHES: a text's k-mer and its place in a source of that seed; ``at`` has both places and whether the seed is a long one.

    And each place of a short seed that several texts have; ``at`` has the place and whether
    the seed is busy.  The rows of a seed come in a row and are matched once all are there;
    heavy ones (see ``heavy_seeds``) have their source wherever they are.
    """
    dealt = seeds_.repartition("bucket").sortWithinPartitions("bucket")
    known, sources, places, _ = heavy

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, th, pos in bucket_seeds(batches):
            done = pos < 0
            pos = np.where(done, ~pos, pos)
            if done.any():
                met = np.flatnonzero(done)
                at = looked_up(h[met], known)[0]
                met, at = met[sources[at] != th[met]], at[sources[at] != th[met]]
                yield match_rows(th[met], sources[at], pos[met] << 32 | places[at] << 1 | h[met] & 1)
            busy = done.copy()
            seen = done & (h & 1 == 0)
            if not done.all():
                k = np.flatnonzero(~done)
                row, source, texts = matched(h[k], th[k])
                row, source = k[row], k[source]
                yield match_rows(th[row], th[source], pos[row] << 32 | pos[source] << 1 | h[row] & 1)
                busy[k] = texts > RARE
                seen[k] = (texts > 1) & (h[k] & 1 == 0)
            yield pa.RecordBatch.from_arrays([pa.array(h[seen]), pa.array(th[seen]), pa.nulls(int(seen.sum()), pa.int64()), pa.array(pos[seen] << 1 | busy[seen])], ["h", "th", "src", "at"])

    return dealt.mapInArrow(tidied(run), MATCHES)


def company(h: np.ndarray, th: np.ndarray, pos: np.ndarray, busy: np.ndarray, mth: np.ndarray, src: np.ndarray, mpos: np.ndarray, spos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(busy row, row of its company, whether the busy row's source lacks the pair) of rows sorted by text and place; the m are matches of short seeds."""
    texts, text = np.unique(th, return_inverse=True)
    place = text << 32 | pos
    head = np.flatnonzero(busy)
    n = np.searchsorted(place, place[head] + NEAR, "right") - head - 1
    a = np.repeat(head, n)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    a, b = a[h[a] != h[b]], b[h[a] != h[b]]
    # the source of a busy row, and its place there
    sources, source = np.unique(src, return_inverse=True)
    row = np.searchsorted(place, np.searchsorted(texts, mth) << 32 | mpos)
    own, own_pos = np.full(len(h), -1), np.zeros(len(h), np.int64)
    own[row], own_pos[row] = source, spos
    key = row * len(sources) + source
    order = np.argsort(key)
    key, spos = key[order], spos[order]
    alone = np.ones(len(a), bool)
    if len(key):
        asked = b * len(sources) + own[a]
        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        step = spos[at] - own_pos[a]
        alone = (own[a] < 0) | (key[at] != asked) | (step <= 0) | (step > NEAR)
    return a, b, alone


def pairs_of(th: np.ndarray, row: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the company (row and key, each once) of a busy seed's rows, sorted by text: (entry, entry of the source).

    An entry has all sources of smaller ``th`` with its key if no more than RARE texts have it; else
    the smallest text of all if it has the key, as it has the seed too; else one of those that
    share most of the keys that no source before shares.
    """
    order = np.lexsort((row, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    text = th[row[order]]
    other = new.copy()
    other[1:] |= text[1:] != text[:-1]
    first = np.maximum.accumulate(np.where(other, np.arange(len(order)), 0))  # of the text among those of the key
    group = np.cumsum(new) - 1
    few = np.bincount(group, weights=other)[group] <= RARE
    n = np.empty(len(order), np.int64)
    start, rare = n.copy(), np.empty(len(order), bool)
    n[order], start[order], rare[order] = first - begin, begin, few
    led = ~rare & (th[row[order[start]]] == th[row[0]]) & (n > 0)  # the seed's first text has the key too
    yield np.flatnonzero(led), order[start[led]]
    n[led] = 0
    # entries are sorted by row: blocks of whole rows
    total = np.cumsum(n)
    edges = np.flatnonzero(np.append(np.diff(row) != 0, True)) + 1 if len(row) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(row):
        most = (total[lo - 1] if lo else 0) + BLOCK
        hi = int(max(edges[np.searchsorted(edges, lo, "right")], edges[max(0, np.searchsorted(edges, np.searchsorted(total, most, "right"), "right") - 1)]))
        entry = np.repeat(np.arange(lo, hi), n[lo:hi])
        source = order[start[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])]
        yield entry[rare[entry]], source[rare[entry]]
        while len(entry):
            pair = row[entry] * (int(row[-1]) + 1) + row[source]
            found, at, count = np.unique(pair, return_inverse=True, return_counts=True)
            of = found // (int(row[-1]) + 1)
            best = np.lexsort((found, -count, of))
            best = best[np.append(True, np.diff(of[best]) != 0)]
            chosen = np.zeros(len(found), bool)
            chosen[best] = True
            chosen = chosen[at]
            out = chosen & ~rare[entry]
            yield entry[out], source[out]
            left = ~np.isin(entry, entry[chosen])
            entry, source = entry[left], source[left]
        lo = hi


def listed_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, th, at, key, step (hash and distance of one of the company) from rows with LISTS."""
    for batch in batches:
        lists = batch.column("company").to_pylist()
        of = pa.array(np.repeat(np.arange(len(lists)), np.array([len(x) // 12 for x in lists], np.int64)))
        company = np.frombuffer(b"".join(lists), PAIR)
        alone = company["step"] & 1 > 0
        company, of = company[alone], of.filter(pa.array(alone))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("h", "th", "at")), pa.array(company["key"]), pa.array(company["step"] >> 1)], ["h", "th", "at", "key", "step"])


def pair_matches(lists: DataFrame) -> DataFrame:
    """MATCHES of busy seeds and their company, from rows with LISTS."""
    dealt = lists.select("h", "th", "at", "company").repartition("h").sortWithinPartitions("h", "th", "at")

    def met(th: np.ndarray, at: np.ndarray, key: np.ndarray, step: np.ndarray) -> Iterator[np.ndarray]:
        """Of one seed."""
        row = np.cumsum(changes(np.stack([th, at]))) - 1
        once = np.zeros(len(row), bool)  # the nearest place of each of the company
        order = np.lexsort((step, key, row))
        once[order] = changes(np.stack([row, key])[:, order])
        th, at, key, step, row = (x[once] for x in (th, at, key, step, row))
        firsts = np.flatnonzero(changes(row[None]))
        for entry, source in pairs_of(th[firsts], row, key):
            yield np.stack([th[entry], th[source], (at + step)[entry] << 32 | (at + step)[source] << 1])
            a, b = np.divmod(np.unique(row[entry] * len(firsts) + row[source]), len(firsts))
            a, b = firsts[a], firsts[b]
            yield np.stack([th[a], th[b], at[a] << 32 | at[b] << 1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for part in whole(listed_pairs(batches), ("h", "th", "at", "key", "step")):
            for seed in np.split(part[1:], np.flatnonzero(np.diff(part[0])) + 1, 1):
                for rows in met(*seed) if seed[0, 0] != seed[0, -1] else ():
                    waiting.append(rows)
                    if len(waiting) >= 256 or rows.shape[1] >= BLOCK // 8:
                        yield match_rows(*np.concatenate(waiting, 1))
                        waiting = []
        if waiting:
            yield match_rows(*np.concatenate(waiting, 1))

    return dealt.mapInArrow(tidied(run), MATCHES)


def word_bytes(docs: DataFrame) -> DataFrame:
    """th and words (two bytes for each, a number from 1 on) of each text; not each text once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, texts in new_texts(batches):
            w = W.find_words(texts)
            data = np.maximum(W.mix64(w.hashes()) >> np.uint64(48), 1).astype(np.uint16)
            k = np.flatnonzero(np.diff(w.first) >= MIN_WORDS)
            words = [data[w.first[i] : w.first[i + 1]].tobytes() for i in k.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(th[k]), pa.array(words, pa.binary())], ["th", "words"])

    return hashed_texts(docs).mapInArrow(tidied(run), "th long, words binary")


def around(words: bytes, places: list[int]) -> list[bytes]:
    """The words up to SIDE + DRIFT before and behind each place, zeros where the text has none."""
    side = 2 * (SIDE + DRIFT)
    padded = bytes(side) + words + bytes(side)
    return [padded[2 * p : 2 * p + 2 * side] for p in places]


def passable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words around pairs of places (columns of words) of ``b`` that ``a`` has, whether they allow a passage there, and make one for sure.

    A word of ``b`` that ``a`` lacks within DRIFT words of its place is missed; a passage of
    MIN_WORDS words and more that has the place must miss no more than its identity allows.
    """
    words = b[DRIFT:-DRIFT]
    hit, equal = np.zeros(words.shape, bool), np.empty(words.shape, bool)
    for d in range(2 * DRIFT + 1):
        hit |= np.equal(a[d : d + 2 * SIDE], words, out=equal)
    hit &= words > 0
    # words that don't have enough of the others anywhere are left out first
    some = np.flatnonzero(np.add.reduce(hit.view(np.uint8), 0, dtype=np.uint8) >= round(IDENTITY * MIN_WORDS))
    allowed, certain = np.zeros((2, words.shape[1]), bool)
    if not len(some):
        return hit, allowed, certain
    own = words[:, some]
    # in fifths of a word: what n words allow less what they miss
    worth = round(5 * (1 - IDENTITY)) - 5 * (~hit[:, some]).astype(np.int16)
    zero = np.zeros((1, len(some)), np.int16)
    right = np.concatenate([zero, np.cumsum(worth[SIDE:], 0, dtype=np.int16)])
    left = np.concatenate([zero, np.cumsum(worth[:SIDE][::-1], 0, dtype=np.int16)])
    best = np.maximum.accumulate(right[::-1], 0)[::-1]  # of so many words and more on the right
    for n in range(SIDE + 1):
        allowed[some] |= left[n] + best[min(SIDE, max(K, MIN_WORDS - n))] >= 0
    same = np.concatenate([zero, np.cumsum((a[DRIFT:-DRIFT, some] == own) & (own > 0), 0, dtype=np.int16)])
    # an extension goes on behind two other words for ENDS same ones
    ends = same[ENDS:] - same[:-ENDS] == ENDS
    sure_ = ((same[MIN_WORDS:] - same[:-MIN_WORDS]) >= MIN_WORDS - 2) & ends[: -MIN_WORDS + ENDS] & ends[MIN_WORDS - ENDS :]
    certain[some] = allowed[some] & sure_[K : SIDE + 1].any(0)
    return hit, allowed, certain


def fewest(b: np.ndarray, hit: np.ndarray, certain: np.ndarray) -> np.ndarray:
    """Which pairs stay: of those of one ``b`` (in a row), what has less than MIN_SPAN words beyond those of a certain one goes."""
    stays = np.ones(len(b), bool)
    for lo, hi in itertools.pairwise([*np.flatnonzero(changes(b[None])).tolist(), len(b)]):
        left = np.arange(lo, hi)
        while len(left) > 1 and certain[left].any():
            best = left[np.argmax(np.where(certain[left], hit[:, left].sum(0), -1))]
            left = left[left != best]
            gone = (hit[:, left] & ~hit[:, [best]]).sum(0) < MIN_SPAN
            stays[left[gone]] = False
            left = left[~gone]
    return stays


def rarer(freq: np.ndarray) -> np.ndarray:
    """Which word pairs around places (columns, from SIDE words before on) are looked up: not those of the seed, nor the most frequent of all that make up COMMON words with it."""
    kept, columns = freq > 0, np.arange(freq.shape[1])
    kept[SIDE : SIDE + K - 1] = False
    common = np.zeros((len(freq) + 1, freq.shape[1]), bool)
    common[SIDE : SIDE + K] = True
    left = np.full(freq.shape[1], COMMON - K)
    for k in np.argsort(np.where(kept, -freq, 1), 0, kind="stable")[:FREQUENT]:
        new = 2 - common[k, columns].astype(np.int64) - common[k + 1, columns]
        goes = kept[k, columns] & (new <= left)
        left -= np.where(goes, new, 0)
        k, of = k[goes], columns[goes]
        kept[k, of] = False
        common[k, of] = common[k + 1, of] = True
    return kept


def near_pairs(b: np.ndarray, n: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of ``b``, one of the first ``n`` places) that may lie in one passage, by ``words`` around the places (columns), those of a ``b`` in a row.

    A passage has MIN_WORDS words, of which no more than a fifth are missed, so it has words
    beyond COMMON ones, and these aren't all single: an extension goes on for two words or
    more only, and the misses are too few to part all others.  Its word pairs there are
    looked up.  Where that isn't less work than all pairs of places, these are given.
    """

    def blocks(of: np.ndarray, count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        """Ranges of the entries of ``count``, never cut within an ``of``, of about ``most`` in all."""
        total = W.prefix(count)
        edges = np.append(np.flatnonzero(changes(of[None])), len(of))
        lo = 0
        while lo < len(of):
            hi = int(max(edges[np.searchsorted(edges, lo, "right")], edges[np.searchsorted(edges, np.searchsorted(total, total[lo] + most, "right") - 1, "right") - 1]))
            yield lo, hi
            lo = hi

    def each(of: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(of, count), np.repeat(start - W.prefix(count)[:-1], count) + np.arange(count.sum())

    def paired(columns: np.ndarray) -> np.ndarray:
        """Two words in a row as one number, 0 if there are not two."""
        first, second = columns[:-1].astype(np.int64), columns[1:]
        return np.where((first > 0) & (second > 0), first << 16 | second, 0)

    if n.sum() <= FEW:
        yield each(b, np.zeros(len(b), np.int64), n)
        return
    # each word pair with the places that have it
    codes = paired(words)
    entries = (codes << 31 | np.arange(words.shape[1])).T.ravel()[codes.T.ravel() > 0]
    entries.sort()
    entries = entries[changes(entries[None])]
    for k in range(0, len(b), COMPARED):
        some, least = b[k : k + COMPARED], n[k : k + COMPARED]
        codes = paired(words[DRIFT:-DRIFT, some])
        start = np.searchsorted(entries, codes << 31)
        count = np.searchsorted(entries, codes << 31 | least) - start
        kept = rarer(np.where(codes > 0, count, 0))
        dense = np.where(kept, count, 0).sum(0) > least * PAIRED
        of, at = np.nonzero((kept & ~dense).T)
        count, start = count[at, of], start[at, of]
        for lo, hi in blocks(of, count, BLOCK):
            x, y = each(of[lo:hi], start[lo:hi], count[lo:hi])
            pair, times = np.unique(x << 31 | entries[y] & 0x7FFFFFFF, return_counts=True)
            pair = pair[times >= PAIRED]
            yield some[pair >> 31], pair & 0x7FFFFFFF
        of = np.flatnonzero(dense)
        for lo, hi in blocks(of, least[of], BLOCK // 4):
            yield each(some[of[lo:hi]], np.zeros(hi - lo, np.int64), least[of[lo:hi]])


def rest_pairs(th: np.ndarray, part: np.ndarray, closed: np.ndarray, prior: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(open place, place of a text of smaller hash) of a busy seed that may lie in one passage; places are sorted by text.

    Those that the same busy seed precedes at once (``prior``) are left out: they are compared
    there.  If there are two parts, only places of different parts are compared.
    """
    open_ = np.flatnonzero(~closed)
    two = part.min() != part.max()
    for b, a in near_pairs(open_, np.searchsorted(th, th[open_]), words):
        asked = (prior[a] != prior[b]) | (prior[a] == 0)
        if two:
            asked &= part[a] != part[b]
        a, b = a[asked], b[asked]
        for k in range(0, len(a), COMPARED):
            x, y = b[k : k + COMPARED], a[k : k + COMPARED]
            hit, allowed, certain = passable(np.take(words, y, 1), np.take(words, x, 1))
            if allowed.any():
                k = np.flatnonzero(allowed)
                k = k[fewest(x[k], hit[:, k], certain[k])]
                yield x[k], y[k]


def with_words(places: DataFrame, docs: DataFrame) -> DataFrame:
    """``places`` (of texts th) with ``around``: the words around each place ``at``."""
    rows = places.withColumn("words", F.lit(None).cast("binary")).unionByName(word_bytes(docs).withColumn("at", F.lit(-1)), allowMissingColumns=True)
    dealt, names = rows.repartition("th").sortWithinPartitions("th", "at"), places.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, bytes] = {}
        for batch in batches:
            known = batch.column("words").is_valid()
            texts = batch.filter(known)
            words.update(zip(texts.column("th").to_pylist(), texts.column("words").to_pylist(), strict=True))
            asked = batch.filter(pc.invert(known))
            th, at = (asked.column(c).to_numpy() for c in ("th", "at"))
            edges = [*np.flatnonzero(changes(th[None])).tolist(), len(th)]
            near = [x for a, b in itertools.pairwise(edges) for x in around(words[int(th[a])], at[a:b].tolist())]
            yield pa.RecordBatch.from_arrays([*(asked.column(c) for c in names), pa.array(near, pa.binary())], [*names, "around"])
            last = batch.column("th")[-1].as_py() if batch.num_rows else None
            words = {t: w for t, w in words.items() if t == last or last is None}

    return dealt.mapInArrow(tidied(run), T.StructType([*places.schema.fields, T.StructField("around", T.BinaryType())]))


def rest_matches(lists: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """MATCHES of places of a busy seed that no passage ``found`` has with its company, from rows with LISTS; see ``rest_pairs``.

    The places of a frequent seed are dealt into parts of about PART, and each two parts meet in one group.
    """
    have = found.groupBy("th").agg(F.array_distinct(F.collect_list(F.struct("begin", "end"))).alias("have"))
    inside = lambda at, reach: F.coalesce(F.exists("have", lambda p: (p["begin"] <= at) & (p["end"] >= reach)), F.lit(False))
    slim = lists.join(have, "th", "left").withColumn("closed", inside(F.col("at"), F.col("reach")))
    before = inside(F.col("at") - F.col("prior").bitwiseAND(F.lit(15)), F.col("before"))
    slim = slim.withColumn("prior", F.when(before == F.col("closed"), F.col("prior")).otherwise(0)).select("h", "th", "at", "company", "closed", "prior")
    slim = slim.join(slim.where("not closed").select("h").distinct(), "h", "left_semi")
    big = slim.groupBy("h").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = with_words(slim, docs).join(F.broadcast(big), "h", "left").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "th"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "other")
    dealt = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "th", "at")

    def of_group(rows: pa.Table) -> Iterator[np.ndarray]:
        th, at, part, closed, prior = (rows.column(c).to_numpy().astype(np.int64) for c in ("th", "at", "part", "closed", "prior"))
        if closed.all():
            return
        words = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("around").to_pylist()), np.uint16).reshape(len(th), -1).T)
        known: dict[int, dict[int, int]] = {}

        def steps(k: int) -> dict[int, int]:
            """The nearest place of each of the company."""
            if k not in known:
                pairs = np.frombuffer(rows.column("company")[k].as_py(), PAIR)[::-1]
                known[k] = dict(zip(pairs["key"].tolist(), (pairs["step"] >> 1).tolist(), strict=True))
            return known[k]

        for a, b in rest_pairs(th, part, closed > 0, prior, words):
            found = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = steps(x), steps(y)
                shared = p.keys() & q.keys()
                if shared:
                    found += [(x, y, 0, 0), *((x, y, p[k], q[k]) for k in shared)]
            if found:
                x, y, p, q = np.array(found, np.int64).T
                yield np.stack([th[x], th[y], (at[x] + p) << 32 | (at[y] + q) << 1])

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h", "i", "j")])
            edges = np.flatnonzero(changes(key)).tolist()
            if not edges:
                continue
            if held and any(held[0].column(c)[0] != batch.column(c)[0] for c in ("h", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
            for lo, hi in itertools.pairwise([*edges, batch.num_rows]):
                held.append(batch.slice(lo, hi - lo))
                if hi < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for group in groups(batches):
            for rows in of_group(group) if group.num_rows > 1 else ():
                waiting.append(rows)
                if len(waiting) >= 256 or rows.shape[1] >= BLOCK // 8:
                    yield match_rows(*np.concatenate(waiting, 1))
                    waiting = []
        if waiting:
            yield match_rows(*np.concatenate(waiting, 1))

    return dealt.mapInArrow(tidied(run), MATCHES)


def segments(group: np.ndarray, pos: np.ndarray, spos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group, places, words and seeds of the matches (of ``size`` words) that overlap on a diagonal of their group, by group and place."""
    if not len(pos):
        return (np.zeros(0, np.int64),) * 5
    order = np.lexsort((pos, pos - spos, group))
    group, pos, spos, size = (x[order] for x in (group, pos, spos, size))
    line = np.ones(len(pos), bool)
    line[1:] = (group[1:] != group[:-1]) | (np.diff(pos - spos) != 0)
    number = np.cumsum(line) << 32
    end = np.maximum.accumulate(number + pos + size)
    begins = line.copy()
    begins[1:] |= number[1:] + pos[1:] > end[:-1]
    again = np.zeros(len(pos), bool)
    again[1:] = ~line[1:] & (pos[1:] == pos[:-1]) & (size[1:] == size[:-1])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(pos)) - 1
    seeds_ = np.add.reduceat(np.where(again, 0, size // K), first)
    order = np.lexsort((spos[first], pos[first], group[first]))
    return tuple(x[order] for x in (group[first], pos[first], spos[first], (end[last] & 0xFFFFFFFF) - pos[first], seeds_))


def chains(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Chains of segments (x ascending), as their indices, from the best on; each segment is in one."""
    n = len(x)
    rank = np.searchsorted(np.unique(y), y) + 1
    most = int(rank.max())
    tree_value, tree_item = [-np.inf] * (most + 1), [-1] * (most + 1)  # Fenwick tree: prefix maxima over y
    xs, ys, rs, ns = x.tolist(), y.tolist(), rank.tolist(), size.tolist()
    score, back = [0.0] * n, [-1] * n
    waiting = 0
    for i in range(n):
        while xs[waiting] < xs[i]:  # only segments with a smaller x may precede
            value, r = score[waiting] + GAP_COST * (xs[waiting] + ys[waiting] + 2 * ns[waiting]), rs[waiting]
            while r <= most:
                if value > tree_value[r]:
                    tree_value[r], tree_item[r] = value, waiting
                r += r & -r
            waiting += 1
        best, item, r = -np.inf, -1, rs[i] - 1
        while r > 0:
            if tree_value[r] > best:
                best, item = tree_value[r], tree_item[r]
            r -= r & -r
        score[i] = float(ns[i])
        if item >= 0:
            new = min(ns[i], xs[i] + ns[i] - xs[item] - ns[item], ys[i] + ns[i] - ys[item] - ns[item])
            joined = best - GAP_COST * (xs[i] + ys[i] + 2 * (ns[i] - new)) + new
            if new > 0 and joined > score[i]:
                score[i], back[i] = joined, item
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda k: (-score[k], k)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def sure(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> bool:
    """Whether the segments of a chain are a passage by themselves."""
    x_end, y_end = np.maximum.accumulate(x + size), np.maximum.accumulate(y + size)
    over = np.zeros(len(x), np.int64)  # words of a segment that those before have
    over[1:] = np.maximum(0, np.maximum(x_end[:-1] - x[1:], y_end[:-1] - y[1:]))
    least, most = sorted((int(x_end[-1] - x[0]), int(y_end[-1] - y[0])))
    return least >= MIN_WORDS and int(np.maximum(0, size - over).sum()) >= IDENTITY * most


def text_chains(groups: list[tuple[int, int]], x: np.ndarray, y: np.ndarray, size: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(begin of its group, indices) of the chains of a text; a group has the segments of one source."""
    covered: list[tuple[int, int]] = []  # disjoint intervals of sure chains

    def open_words(a: int, b: int) -> int:
        return b - a - sum(max(0, min(b, d) - max(a, c)) for c, d in covered)

    for a, b in sorted(groups, key=lambda g: (-n[g[0] : g[1]].sum(), g[0])):
        if n[a:b].sum() < MIN_SEEDS or covered and open_words(int(x[a]), int((x[a:b] + size[a:b]).max())) < MIN_SPAN:
            continue
        for c in chains(x[a:b], y[a:b], size[a:b]) if b - a > 1 else (np.zeros(1, np.int64),):
            c = c + a
            begin, end = int(x[c[0]]), int((x[c] + size[c]).max())
            if n[c].sum() < MIN_SEEDS or end - begin < MIN_SPAN or open_words(begin, end) < MIN_SPAN:
                continue
            yield a, c
            if sure(x[c], y[c], size[c]):
                inside = [(p, q) for p, q in covered if q >= begin and p <= end]
                covered = [i for i in covered if i not in inside] + [(min([begin, *(p for p, _ in inside)]), max([end, *(q for _, q in inside)]))]


#: A chain: th, src, first and last place in both, and its segments as triples (places and words) of int32.
CHAINS = "th long, src long, a int, b int, sa int, sb int, anchors binary"
#: A busy seed's company: h, its place at, PAIRs of the company, the end of the company,
#: and the busy seed that it follows at once with its distance, or 0, and the end of that one's company.
LISTS = "h long, at int, company binary, reach int, prior long, before int"


def chain_table(found: DataFrame) -> DataFrame:
    """CHAINS of each text, and rows with LISTS and th, from its MATCHES."""
    dealt = found.withColumn("seen", F.col("src").isNull().cast("int")).repartition("th").sortWithinPartitions("th", "src", "at")
    names = ["th", "src", "a", "b", "sa", "sb", "anchors", "h", "at", "company", "reach", "prior", "before"]
    types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32()]

    def chained(th: np.ndarray, src: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """Of whole texts."""
        new = np.ones(len(th), bool)
        new[1:] = (th[1:] != th[:-1]) | (src[1:] != src[:-1])
        first = np.flatnonzero(new)
        group, x, y, size, n = segments(np.cumsum(new) - 1, at >> 32, at >> 1 & 0x7FFFFFFF, np.where(at & 1, LONG_K, K))
        rows: list[tuple] = []
        edges = np.searchsorted(group, np.arange(len(first) + 1)).tolist()
        text = th[first]
        texts = [0, *(np.flatnonzero(np.diff(text)) + 1).tolist(), len(text)] if len(text) else []
        for p, q in itertools.pairwise(texts):
            for a, c in text_chains(list(itertools.pairwise(edges[p : q + 1])), x, y, size, n):
                of = first[group[a]]
                rows.append((int(th[of]), int(src[of]), int(x[c[0]]), int((x[c] + size[c]).max()), int(y[c[0]]), int((y[c] + size[c]).max()), np.stack([x[c], y[c], size[c]], 1).astype(np.int32).tobytes()))
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], types[k]) for k in range(7)), *(pa.nulls(len(rows), t) for t in types[7:])], names)

    def listed(h: np.ndarray, th: np.ndarray, at: np.ndarray, mth: np.ndarray, src: np.ndarray, mat: np.ndarray) -> pa.RecordBatch:
        short = mat & 1 == 0
        pos, busy = at >> 1, at & 1 > 0
        row, other, alone = company(h, th, pos, busy, mth[short], src[short], mat[short] >> 32, mat[short] >> 1 & 0x7FFFFFFF)
        reach = pos + K  # end of the company
        np.maximum.at(reach, row, pos[other] + K)
        prior, before = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        step = np.diff(np.unique(th, return_inverse=True)[1] << 32 | pos)
        after = np.flatnonzero((step <= K) & (step > 0) & busy[:-1] & busy[1:] & (h[:-1] != h[1:])) + 1
        prior[after], before[after] = h[after - 1] & ~np.int64(15) | step[after - 1], reach[after - 1]
        first = np.flatnonzero(changes(row[None]))
        pairs = np.empty(len(row), PAIR)
        pairs["key"], pairs["step"] = h[other], (pos[other] - pos[row]) << 1 | alone
        lists = [pairs[a:b].tobytes() for a, b in itertools.pairwise([*first.tolist(), len(row)])]
        k = row[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(th[k]), *(pa.nulls(len(k), t) for t in types[1:7]), pa.array(h[k]), pa.array(pos[k].astype(np.int32)), pa.array(lists, pa.binary())]
            + [pa.array(reach[k].astype(np.int32)), pa.array(prior[k]), pa.array(before[k].astype(np.int32))],
            names,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, src, at, h, seen in whole(batches, ("th", "src", "at", "h", "seen")):
            s, m = (seen > 0) & changes(np.stack([th, at, seen])), seen == 0
            yield chained(th[m], src[m], at[m])
            if s.any():
                yield listed(h[s], th[s], at[s], th[m], src[m], at[m])

    return dealt.mapInArrow(tidied(run), f"{CHAINS}, {LISTS}")


CHAIN_NAMES = [c.split()[0] for c in CHAINS.split(", ")]


def all_chains(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CHAINS of all texts, those of matches by pairs of seeds too, and the table with the rows with LISTS; both written."""
    heavy = heavy_seeds(docs)
    first = materialize(chain_table(matches(seed_table(docs, heavy[0], heavy[3]), heavy)), "chains")
    swept(docs.sparkSession)  # the seeds' shuffle is the largest
    more = chain_table(pair_matches(first.where(F.col("h").isNotNull()))).select(CHAIN_NAMES)
    return materialize(first.where(F.col("h").isNull()).select(CHAIN_NAMES).unionByName(more), "chains"), first


def spans(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """The word hashes of each request (row, th, lo, hi), from the row's text, which is read once for all of its requests."""
    asked = requests.groupBy("row", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("asked"))
    texts = docs.select(identity("doc_id", "text").alias("row"), "text")
    met = texts.join(asked, "row").select("row", "th", "asked", "text")
    names = ["row", "th", "lo", "hi", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            w = W.find_words(part.column("text"))
            h = w.hashes()
            lists = part.column("asked")
            of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            lo, hi = (lists.flatten().field(k).to_numpy() for k in (0, 1))
            first, last = w.first[:-1][of], w.first[1:][of]
            words = [h[max(0, a) + f : min(b + f, e)].tobytes() for a, b, f, e in zip(lo.tolist(), hi.tolist(), first.tolist(), last.tolist(), strict=True)]
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([part.column("row").take(at), part.column("th").take(at), pa.array(lo), pa.array(hi), pa.array(words, pa.binary())], names)

    # equal rows give equal spans
    return met.mapInArrow(tidied(run), "row binary, th long, lo int, hi int, words binary").dropDuplicates(["row", "th", "lo", "hi"]).drop("row")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; a bit of a big integer for each word of b."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (a == b).all():
        return len(a)
    places: dict[int, int] = {}
    for k, word in enumerate(b.tolist()):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for word in a.tolist():
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def straight(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words on, from the start of both, the score is best before it falls by DROP, and the matches there."""
    n = min(len(a), len(b))
    equal = a[:n] == b[:n]
    score = np.cumsum(np.where(equal, 1.0, -MISMATCH))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    score = score[: fallen[0]] if len(fallen) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    length = int(score.argmax()) + 1
    return length, int(equal[:length].sum())


def extension(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Words of a and of b that an extension from the start of both takes in, and its matches; it goes on behind skipped words while that pays."""
    x = y = matched = 0
    steps: tuple[tuple[int, int], ...] = ((0, 0),)
    words, others = a.tolist(), b.tolist()
    while True:
        gain, step = 0.0, None
        for da, db in steps:
            if not any(map(operator.eq, words[x + da : x + da + FALLEN], others[y + db : y + db + FALLEN])):
                continue  # it falls by DROP before its first match
            n, m = straight(a[x + da :], b[y + db :])
            if m - MISMATCH * (n - m) - MISMATCH * max(da, db) > gain:
                gain, step = m - MISMATCH * (n - m) - MISMATCH * max(da, db), (da + n, db + n, m)
        if step is None and steps is SKIPS:
            return x, y, matched
        if step is not None:
            x, y, matched = x + step[0], y + step[1], matched + step[2]
        steps = SKIPS


def align(a: np.ndarray, b: np.ndarray, anchors: np.ndarray) -> tuple[int, int, int, int, int]:
    """Begin and end in a and in b of the aligned chain, and its matching words."""
    begin, sbegin, _ = anchors[0].tolist()
    x_end, y_end, matched = begin, sbegin, 0
    for x, y, n in anchors.tolist():
        over = max(0, x_end - x, y_end - y)  # words of it that the one before has
        x, y, n = x + over, y + over, n - over
        if n <= 0:
            continue
        matched += common(a[x_end:x], b[y_end:y]) + n
        x_end, y_end = x + n, y + n
    left, sleft, before = extension(a[:begin][::-1], b[:sbegin][::-1])
    right, sright, after = extension(a[x_end:], b[y_end:])
    least, most = sorted((x_end - begin, y_end - sbegin))
    if least >= MIN_WORDS and matched >= IDENTITY * most and matched + before + after < IDENTITY * max(x_end - begin + left + right, y_end - sbegin + sleft + sright):
        return int(begin), int(x_end), int(sbegin), int(y_end), matched  # its extension would cost it its identity
    return int(begin - left), int(x_end + right), int(sbegin - sleft), int(y_end + sright), matched + before + after


def aligned(pairs: DataFrame) -> DataFrame:
    names = ["th", "src", "begin", "end", "src_begin", "src_end", "identity"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["swords"], np.uint64)
                low, slow = max(0, r["lo"]), max(0, r["slo"])
                begin, end, sbegin, send, matched = align(a, b, np.frombuffer(r["anchors"], np.int32).reshape(-1, 3) - [low, slow, 0])
                identity = matched / max(end - begin, send - sbegin)
                if min(end - begin, send - sbegin) >= MIN_WORDS and identity >= IDENTITY:
                    rows.append((r["th"], r["src"], begin + low, end + low, sbegin + slow, send + slow, round(identity, 6)))
            types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], types[k]) for k in range(7)], names)

    return pairs.mapInArrow(tidied(run), "th long, src long, begin int, end int, src_begin int, src_end int, identity double")


def outermost(found: DataFrame) -> DataFrame:
    """Passages without those that lie in another of the same two texts: chains of one passage may be extended to the same words."""
    dealt = found.repartition("th", "src").sortWithinPartitions("th", "src", "begin", F.desc("end"), "src_begin", F.desc("src_end"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, outer = None, []  # the passages of the pair that may hold a later one
        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                if (r["th"], r["src"]) != pair:
                    pair, outer = (r["th"], r["src"]), []
                outer = [o for o in outer if o[0] > r["begin"]]
                keep.append(not any(o[0] >= r["end"] and o[1] <= r["src_begin"] and o[2] >= r["src_end"] for o in outer))
                if keep[-1]:
                    outer.append((r["end"], r["src_begin"], r["src_end"]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(tidied(run), found.schema)


def representatives(docs: DataFrame) -> DataFrame:
    """th, doc_id and row (identity) of the smallest doc_id with each text, and the number n of rows with it.

    Texts are told apart by a second hash too: in the improbable case that two share
    ``th``, n is 0, and such texts are left alone.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identity("doc_id", "text").alias("row"), F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("th2"))
    grouped = slim.groupBy("th").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("rep"), F.count("*").alias("n"), (F.min("th2") == F.max("th2")).alias("one"))
    return grouped.select("th", "rep.doc_id", "rep.row", F.when(F.col("one"), F.col("n")).otherwise(0).alias("n"))


def passages_of(found: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Passages of CHAINS, written."""
    floor_, ceil_ = (lambda c: (F.floor((F.col(c) - PAD) / STEP) * STEP).cast("int")), (lambda c: (F.ceil((F.col(c) + PAD) / STEP) * STEP).cast("int"))
    wide = found.withColumns({"lo": floor_("a"), "hi": ceil_("b"), "slo": floor_("sa"), "shi": ceil_("sb")})
    asked = wide.select("th", "lo", "hi").unionByName(wide.select(F.col("src").alias("th"), F.col("slo").alias("lo"), F.col("shi").alias("hi"))).distinct()
    words = materialize(spans(asked.join(reps.where("n > 0").select("th", "row"), "th"), docs), "spans")
    source = words.select(F.col("th").alias("src"), F.col("lo").alias("slo"), F.col("hi").alias("shi"), F.col("words").alias("swords"))
    result = materialize(outermost(aligned(wide.join(words, ["th", "lo", "hi"]).join(source, ["src", "slo", "shi"]))), "passages")
    discard(found, words)
    swept(docs.sparkSession)
    return result


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages (th, src, begin, end, src_begin, src_end, identity; texts by hash), and ``representatives``."""
    reps = materialize(representatives(docs), "texts")
    found, lists = all_chains(docs)
    result = passages_of(found, reps, docs)
    rest = materialize(chain_table(rest_matches(lists.where(F.col("h").isNotNull()), result, docs)).select(CHAIN_NAMES), "chains")
    discard(lists)
    more = passages_of(rest, reps, docs)
    return outermost(result.unionByName(more)), reps


N_WORDS = r"[^\x20\x09-\x0D]+"
#: Found in texts of MIN_WORDS words and more, by their beginning.
LONG_TEXT = rf"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{{MIN_WORDS}}}"


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per passage of a text that an other text has, and a row per copy of a text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, reps = repeated_passages(docs)
    ids = reps.select("th", "doc_id")
    passages = found.join(ids, "th").join(ids.select(F.col("th").alias("src"), F.col("doc_id").alias("source_doc_id")), "src")
    passages = passages.select("doc_id", "source_doc_id", "begin", "end", "src_begin", "src_end", "identity", F.lit("passage").alias("kind"))
    rows = materialize(docs.select("doc_id", identity("doc_id", "text").alias("row"), F.xxhash64("text").alias("th")), "rows")  # read twice
    copied = reps.where("n > 1").select("th", F.col("doc_id").alias("source_doc_id"), F.col("row").alias("source_row"), "n")
    sources = docs.select(identity("doc_id", "text").alias("source_row"), "text").join(copied.select("source_row"), "source_row", "left_semi")
    lengths = sources.select("source_row", F.regexp_count("text", F.lit(N_WORDS)).alias("end")).where(F.col("end") >= MIN_WORDS).distinct()
    copied = materialize(copied.join(lengths, "source_row"), "copied-texts")
    copies = join_keyed(rows, copied, "th", "n")
    same = copies.groupBy("doc_id", "row", "end", "source_doc_id", "source_row").agg(F.count("*").alias("n_same"))
    repeats = F.col("n_same") - (F.col("row") == F.col("source_row")).cast("long")  # the source is no copy of itself, equal rows are
    copies = same.where(repeats > 0).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), repeats)))
    copies = copies.select("doc_id", "source_doc_id", F.lit(0).alias("begin"), "end", F.lit(0).alias("src_begin"), F.col("end").alias("src_end"), F.lit(1.0).alias("identity"), F.lit("copy").alias("kind"))
    return passages.unionByName(copies)


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """``text`` without the words of the intervals, which may overlap."""
    w = W.find_words(pa.array([text]))
    gone = np.zeros(len(w.starts), bool)
    for a, b in cuts:
        gone[a:b] = True
    keep = np.ones(len(w.data) + 1, np.int8)
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        keep[w.starts[a] : w.ends[b - 1]] = 0
    return w.data[keep[:-1] > 0].tobytes().decode()


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages: the source keeps its words, other texts lose them.

    Copies of a text of MIN_WORDS words and more go, and so do documents that lose
    all their words; n_chars follows the text.  Shorter texts, empty and null ones
    stay as they are and aren't shuffled.
    """
    found, reps = repeated_passages(docs)
    cuts = found.groupBy("th").agg(F.array_distinct(F.collect_list(F.struct("begin", "end"))).alias("cuts"))
    own = own_names(docs)
    names, text = list(own), own["text"]
    renamed = docs.withColumnsRenamed(own)
    enough = F.coalesce(F.col(f"`{text}`").rlike(LONG_TEXT), F.lit(False))
    # a text whose hash another text has too (n = 0) is kept whole, row by row
    plan = reps.where("n > 0").select("th", "row").join(cuts, "th", "left").select(F.col("row").alias("_row"), "cuts", F.lit(True).alias("_first"))
    unsure = F.broadcast(reps.where("n = 0").select(F.col("th").alias("_th")))  # none, or a few in 10^10 texts
    long = renamed.where(enough).withColumn("_row", identity(F.col(f"`{own['doc_id']}`"), F.col(f"`{text}`"))).withColumn("_th", F.xxhash64(F.col(f"`{text}`")))
    kept = long.join(unsure, "_th", "left_anti").dropDuplicates(["_row"]).join(plan, "_row").select(*(f"`{c}`" for c in own.values()), "cuts")
    whole = renamed.where(~enough).unionByName(long.join(unsure, "_th", "left_semi").select(*(f"`{c}`" for c in own.values())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, text):
            texts, cut_lists = part.column(text).to_pylist(), part.column("cuts").to_pylist()
            new = [without(t, [(c["begin"], c["end"]) for c in cs]) if cs else t for t, cs in zip(texts, cut_lists, strict=True)]
            alive = pa.array([not cs or bool(t.strip(" \t\n\v\f\r")) for t, cs in zip(new, cut_lists, strict=True)], pa.bool_())
            columns = {c: part.column(own[c]) for c in names}
            columns["text"] = pa.array(new, part.column(text).type)
            if "n_chars" in columns:
                old = columns["n_chars"]
                columns["n_chars"] = pa.array([len(t) if cs else n for t, cs, n in zip(new, cut_lists, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_pydict(columns).filter(alive)

    return kept.mapInArrow(tidied(run), docs.schema).unionByName(whole.select(*(F.col(f"`{v}`").alias(c) for c, v in own.items())))
