"""Language ID by a linear-chain conditional random field over the words of a text.

Each word is scored by hashed byte n-grams, prefixes and suffixes, and by itself if
it is in the lexicon of the training sample; learned transitions tie neighbouring
words.  Forward-backward gives each word's distribution over languages; a text's
language is the one with the largest sum, its score the mean.  Training sequences
are runs of words from several texts, so the transitions are those of code-switched
text.

The model is fitted on a bounded sample, by language: of each, the labelled texts of at
most ``SAMPLE_CHARS`` characters with the smallest hashes, copies taken once, its share
of ``SAMPLE`` texts but ``SAMPLE_LEAST`` at least.  Prediction takes whole texts:
a chain is cut in chunks whose transfer matrices are multiplied first, which is
exact and makes the number of numpy steps independent of a text's length.

Defined cases: a null text, an empty one or one without letters is ``und`` with
score 0; with no labelled text all are ``und``; ties go to the first language in
code-point order; rows are predicted one by one; a very long text is one slice of its
task's work; an empty table gives an empty result; extra columns take no part, and
of those kept, the ones named like a result (in any case) are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auspex.llm import words as W
from auspex.llm.rows import carried
from auspex.sources.shared import fresh

SAMPLE, SAMPLE_LEAST, SAMPLE_CHARS = 1500, 50, 20_000
LEXICON_COUNT = 4
BITS = 16
NGRAMS, AFFIXES = 4, 3
SEQUENCE, SEQUENCES, BATCH, EPOCHS, RATE = 48, 4000, 250, 6, 0.3
#: Mean length of the runs of one text in a training sequence.
RUNS = (8, 40)
CHUNK = 64
SLICE_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, starts and ends of words (runs of letters), and offsets of texts in them."""
    data, at = W.text_buffer(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return data, starts, stops, np.searchsorted(starts, at)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams and affixes with the number of their word, and the hash of each word."""
    length = ends - starts
    word_of = np.repeat(np.arange(len(starts)), length)
    at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
    left = ends[word_of] - at  # bytes to the word's end
    g, index, of = np.zeros(len(data) + NGRAMS, np.uint64), [], []
    padded = np.concatenate([data, np.zeros(NGRAMS, np.uint8)]).astype(np.uint64) + np.uint64(1)
    down = lambda h, salt: (W.mix64(h + np.uint64(salt << 40)) >> np.uint64(64 - BITS)).astype(np.int32)
    for n in range(1, NGRAMS + 1):
        g[: len(data)] = g[: len(data)] * np.uint64(0x100000001B3) + padded[n - 1 : n - 1 + len(data)]
        fits = left >= n
        index.append(down(g[at[fits]], n))
        of.append(word_of[fits])
        if n <= AFFIXES:
            some = np.flatnonzero(length >= n)
            index += [down(g[starts[some]], 10 + n), down(g[ends[some] - n], 20 + n)]
            of += [some, some]
    return np.concatenate(index), np.concatenate(of).astype(np.int32), W.span_hashes(data, starts, ends)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  #: labels x hashed features
    lexicon: np.ndarray  #: sorted hashes of words
    own: np.ndarray  #: labels x (lexicon + 1); the last is for other words
    transitions: np.ndarray

    def lexical(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def emissions(self, index: np.ndarray, of: np.ndarray, lexical: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(of, weights=self.weights[k][index], minlength=len(lexical)) + self.own[k][lexical] for k in range(len(self.labels))], 1)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(scores: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distribution over labels of each word by forward-backward; ``first``: offsets of texts in the words."""
    n, size = scores.shape
    psi = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    lengths = np.diff(first)
    chunks = -(-lengths // CHUNK)
    text_of = np.repeat(np.arange(len(lengths)), chunks)
    number = np.arange(len(text_of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = (first[:-1][text_of] + number * CHUNK)[:, None] + np.arange(CHUNK)
    valid = at < first[1:][text_of][:, None]
    emit = np.where(valid[:, :, None], psi[np.minimum(at, n - 1)], 1.0)
    opening = number == 0

    product = np.broadcast_to(np.eye(size), (len(text_of), size, size)).copy()  # of a chunk's steps
    for t in range(CHUNK):
        moved = product @ step
        if t == 0:
            moved[opening] = product[opening]
        moved = moved * emit[:, t, None, :]
        product = np.where(valid[:, t, None, None], moved / moved.sum((1, 2), keepdims=True), product)
    enter, leave = np.ones((len(text_of), size)) / size, np.ones((len(text_of), size)) / size
    begin = np.cumsum(chunks) - chunks
    for r in range(1, int(chunks.max(initial=0))):
        some = begin[chunks > r] + r
        enter[some] = _normal((enter[some - 1][:, None, :] @ product[some - 1])[:, 0])
        some = begin[chunks > r] + chunks[chunks > r] - 1 - r
        leave[some] = _normal((product[some + 1] @ leave[some + 1][:, :, None])[:, :, 0])

    forward, backward = np.empty_like(emit), np.empty_like(emit)
    state = enter
    for t in range(CHUNK):
        moved = state @ step
        if t == 0:
            moved[opening] = state[opening]
        state = np.where(valid[:, t, None], _normal(moved * emit[:, t]), state)
        forward[:, t] = state
    state = leave
    for t in range(CHUNK - 1, -1, -1):
        backward[:, t] = state
        before = (state * emit[:, t]) @ step.T
        if t == 0:
            before[opening] = state[opening]
        state = np.where(valid[:, t, None], _normal(before), state)
    return _normal(forward * backward)[valid]


def _pairs(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequences x words x labels) and expected transitions of equally long sequences."""
    n, length, size = scores.shape
    psi, step = np.exp(scores - scores.max(2, keepdims=True)), np.exp(transitions)
    a, b = np.empty_like(psi), np.ones_like(psi)
    a[:, 0] = _normal(psi[:, 0])
    for t in range(1, length):
        a[:, t] = _normal((a[:, t - 1] @ step) * psi[:, t])
    for t in range(length - 2, -1, -1):
        b[:, t] = _normal((b[:, t + 1] * psi[:, t + 1]) @ step.T)
    joint = a[:, :-1, :, None] * step * (b * psi)[:, 1:, None, :]
    return _normal(a * b), (joint / joint.sum((2, 3), keepdims=True)).sum((0, 1))


def fit(texts: list[str], langs: list[str]) -> Model:
    """Maximum likelihood by AdaGrad on sequences of runs of words."""
    labels = sorted(set(langs))
    data, starts, ends, first = tokens(pa.array(texts, pa.string()))
    index, of, hashes = features(data, starts, ends)
    order = np.argsort(of, kind="stable")
    index, offset = index[order], np.searchsorted(of[order], np.arange(len(starts) + 1))
    distinct, counts = np.unique(hashes, return_counts=True)
    lexicon = distinct[counts >= LEXICON_COUNT]
    k = len(labels)
    model = Model(labels, np.zeros((k, 1 << BITS)), lexicon, np.zeros((k, len(lexicon) + 1)), np.zeros((k, k)))
    lexical = model.lexical(hashes)
    gold = np.repeat([labels.index(x) for x in langs], np.diff(first))
    if not len(gold) or k < 2:
        return model
    rng = np.random.default_rng(7)
    filled = np.flatnonzero(np.diff(first))
    by_label = [filled[[langs[t] == x for t in filled]] for x in labels]
    by_label = [x for x in by_label if len(x)]

    def sequence(mean: int) -> np.ndarray:
        out: list[np.ndarray] = []
        while sum(map(len, out)) < SEQUENCE:
            text = rng.choice(by_label[rng.integers(len(by_label))])
            at = rng.integers(first[text], first[text + 1])
            out.append(np.arange(at, min(first[text + 1], at + rng.geometric(1 / mean))))
        return np.concatenate(out)[:SEQUENCE]

    sequences = np.stack([sequence(RUNS[i % len(RUNS)]) for i in range(SEQUENCES)])
    sums = [np.full_like(x, 1e-8) for x in (model.weights, model.own, model.transitions)]
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(SEQUENCES), SEQUENCES // BATCH):
            words = sequences[some].ravel()
            sizes = offset[words + 1] - offset[words]
            idx = index[np.repeat(offset[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            at = np.repeat(np.arange(len(words)), sizes)
            scores = model.emissions(idx, at, lexical[words]).reshape(len(some), SEQUENCE, k)
            p, moves = _pairs(scores, model.transitions)
            target = gold[sequences[some]]
            error = (np.eye(k)[target] - p).reshape(-1, k)
            seen = np.zeros((k, k))
            np.add.at(seen, (target[:, :-1].ravel(), target[:, 1:].ravel()), 1)
            steps = (
                np.stack([np.bincount(idx, weights=error[at, j], minlength=1 << BITS) for j in range(k)]),
                np.stack([np.bincount(lexical[words], weights=error[:, j], minlength=len(lexicon) + 1) for j in range(k)]),
                seen - moves,
            )
            for value, total, g in zip((model.weights, model.own, model.transitions), sums, steps, strict=True):
                g = g / len(some)
                total += g * g
                value += RATE * g / np.sqrt(total)
    model.own[:, -1] = 0.0
    return model


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() if c.isascii() else unicodedata.category(c)[0] == "L" for c in text)


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of language changes between words of each text."""
    n = len(texts)
    langs, score, changes = ["und"] * n, np.zeros(n), np.zeros(n, np.int64)
    data, starts, ends, first = tokens(texts)
    if not model.labels or not len(starts):
        return langs, score, changes
    index, of, hashes = features(data, starts, ends)
    p = marginals(model.emissions(index, of, model.lexical(hashes)), model.transitions, first)
    sums = np.stack([W.prefix_of(p[:, k])[first[1:]] - W.prefix_of(p[:, k])[first[:-1]] for k in range(p.shape[1])], 1)
    best = p.argmax(1)
    text_of = np.repeat(np.arange(n), np.diff(first))
    moved = (best[1:] != best[:-1]) & (text_of[1:] == text_of[:-1])
    changes = np.bincount(text_of[1:][moved], minlength=n)
    for t in np.flatnonzero(np.diff(first)).tolist():
        if has_letter(texts[t].as_py()):
            k = int(sums[t].argmax())
            langs[t], score[t] = model.labels[k], min(1.0, float(sums[t, k] / (first[t + 1] - first[t])))
    changes[[x == "und" for x in langs]] = 0
    return langs, score, changes


def train(docs: DataFrame, lang: str = "lang") -> Model:
    """The model from the sample of ``docs`` (text and ``lang``), in which every language has its part.

    Of a language, texts below a hash that about four samples are below come to the
    driver's choice, each once, so what tasks send to it doesn't grow with the input
    or with copies; it grows with the number of languages.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    counts = {r[lang]: r["n"] for r in labelled.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    size = max(SAMPLE_LEAST, SAMPLE // len(counts))
    shares = [(x, int(min(1.0, 4 * size / n) * 2**53)) for x, n in counts.items()]
    bound = F.broadcast(docs.sparkSession.createDataFrame(shares, "_lang string, _bound long"))  # a row a language
    low = labelled.select("text", lang, F.xxhash64("text").alias("h")).join(bound, F.col(lang) == F.col("_lang")).where(F.shiftrightunsigned("h", 11) <= F.col("_bound"))
    first = F.row_number().over(Win.partitionBy(lang).orderBy("h"))
    rows = low.dropDuplicates(["h", lang]).withColumn("_n", first).where(F.col("_n") <= size).orderBy("h", lang).select("text", lang).collect()
    return fit([r["text"] for r in rows], [r[lang] for r in rows])


def with_language(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, and lang_pred, score and n_changes from ``text``."""
    new = ["lang_pred", "score", "n_changes"]
    keep = carried(docs.select(keep), *new)
    names = [*keep, *new]
    source_text = fresh(docs, "text")["text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, source_text, SLICE_BYTES):
            langs, score, changes = predict(part.column(source_text), model)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score), pa.array(changes)], names)

    source = docs.select(*keep, F.col("text").alias(source_text))
    schema = T.StructType([*docs.select(keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_changes", T.LongType())])
    return source.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")))
    return with_language(docs, model, ["doc_id", "held_out"])
