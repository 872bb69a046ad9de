"""The dealt methods themselves: against enumeration, brute force and other engines, also beyond their block sizes."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from auspex.llm import bpe, chat, langid, licenses, mixing, neardup, passages, quality, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def changed(rng: random.Random, text: list[str], share: float) -> list[str]:
    return [f"c{rng.randrange(10**6)}" if rng.random() < share else w for w in text]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    scores, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 3, 3, 7])
    got = langid.marginals(scores, moves, first)
    for a, b in ((0, 3), (3, 7)):
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            weight = math.exp(sum(scores[a + k, y] for k, y in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path)))
            for k, y in enumerate(path):
                total[k, y] += weight
        assert np.allclose(got[a:b], total / total.sum(1, keepdims=True))


def test_marginals_of_a_long_text_equal_plain_recursions():
    rng = np.random.default_rng(4)
    n = 5 * langid.CHUNK + 7
    scores, moves = rng.normal(size=(n, 4)), rng.normal(size=(4, 4))
    a, b = np.zeros((n, 4)), np.ones((n, 4))
    a[0] = np.exp(scores[0]) / np.exp(scores[0]).sum()
    for t in range(1, n):
        a[t] = (a[t - 1] @ np.exp(moves)) * np.exp(scores[t])
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = np.exp(moves) @ (np.exp(scores[t + 1]) * b[t + 1])
        b[t] /= b[t].sum()
    want = a * b / (a * b).sum(1, keepdims=True)
    assert np.allclose(langid.marginals(scores, moves, np.array([0, n])), want)


def test_rare_languages_are_in_the_model(spark):
    rows = [(f"haus wald berg {k} fluss", "de") for k in range(4000)] + [(f"river stone hill {k}", "en") for k in range(4000)] + [("casa monte rio verde", "es"), ("monte rio casa azul", "es")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.labels == ["de", "en", "es"]


def test_language_keeps_names_apart(spark):
    docs = spark.createDataFrame([("a b", 1.0, "x")], "text string, Score double, id string")
    out = langid.with_language(docs, langid.Model([], np.zeros((0, 1)), np.zeros(0, np.uint64), np.zeros((0, 1)), np.zeros((0, 0))), ["id", "Score"])
    assert out.columns == ["id", "lang_pred", "score", "n_changes"] and out.collect()[0]["lang_pred"] == "und"


def test_pieces_whose_merges_fall_in_rank(tmp_path):
    """A merge may make a pair of a lower rank: such pieces are merged one by one."""
    tokens = [bytes([b]) for b in range(256)]
    tokens[3:3] = [b"abc", b"cab"]
    tokens += [b"ab", b"ca", b"bc", b"aa", b"abab"]
    ranks = {t: k for k, t in enumerate(tokens)}
    path = tmp_path / "tiny.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {k}\n" for t, k in ranks.items()))
    made = tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["abc", "cabab", "aabcab"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    got = bpe.Encoder(str(path), r"\S+|\s+").encode(pa.array(texts)).to_pylist()
    assert got == [made.encode(t) for t in texts]
    assert [bpe.merge_one(t.encode(), bpe.ranks_of(str(path))) for t in texts] == got


def test_a_long_piece_is_merged_by_a_heap():
    path, pattern = bpe.byte_bpe_50k()
    rng = random.Random(2)
    piece = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000)).encode()
    assert bpe.merge_one(piece, bpe.ranks_of(path)) == bpe.Encoder(path, pattern).encode(pa.array([piece.decode()])).to_pylist()[0]


def brute_classes(texts: list[str | None]) -> list[tuple[int, int, int]]:
    """class_id, copy_of, n_links of each text by all pairs."""
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    each = list(dict.fromkeys(sets))
    root, links = list(range(len(each))), [0] * len(each)
    for a in range(len(each)):
        for b in range(a):
            both = len(each[a] & each[b])
            if both and 10 * both >= 8 * (len(each[a]) + len(each[b]) - both):
                links[a], links[b] = links[a] + 1, links[b] + 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    at = {s: k for k, s in enumerate(each)}
    first = {s: sets.index(s) for s in each}
    least = {r: min(first[each[k]] for k in range(len(each)) if root[k] == r) for r in set(root)}
    return [(least[root[at[s]]], first[s], links[at[s]]) for s in sets]


@pytest.mark.parametrize(("node_rows", "block"), [(neardup.NODE_ROWS, neardup.BLOCK), (8, 16)])
def test_forest_on_both_sides_of_its_bounds(spark, node_rows, block):
    rng = random.Random(11)
    base = words(rng, 150)
    texts: list[str | None] = [" ".join(changed(rng, base, share)) for share in (0.002, 0.005, 0.01, 0.02) for _ in range(30)]
    for _ in range(40):
        one = words(rng, rng.randrange(20, 90))
        texts += [" ".join(one), " ".join(changed(rng, one, 0.03)), " ".join(one[: int(0.9 * len(one))])]
    texts += ["", None, "a b c d", "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in neardup.near_duplicates(docs, node_rows=node_rows, block=block).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts)


def test_keep_one_with_clashing_names_and_equal_rows(spark):
    text = " ".join(words(random.Random(5), 30))
    rows = [(2, text, 1, "x"), (1, text, 2, "y"), (1, text, 2, "y"), (3, None, 3, "z"), (None, "", 4, "v")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _row int, `set` string")).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([1, 3])


def longest_common(a: list[str], b: list[str]) -> int:
    line = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b):
            line[k + 1], before = before + 1 if x == y else max(line[k + 1], line[k]), line[k + 1]
    return line[-1]


def test_recall_of_fuzzy_passages(spark):
    """Planted passages of 60 words at identities of 0.8 to 1, half of them with bits that other texts quote."""
    rng = random.Random(7)
    texts: list[str] = []
    pairs: dict[bool, list[tuple[int, int]]] = {False: [], True: []}
    for share in (0.0, 0.05, 0.1, 0.13, 0.17):
        for busy in (False, True):
            for _ in range(12):
                passage = words(rng, 60)
                copy = changed(rng, passage, share)
                if longest_common(passage, copy) < 48:
                    continue
                texts.append(" ".join(words(rng, 60) + passage + words(rng, 40)))
                texts.append(" ".join(words(rng, 50) + copy + words(rng, 70)))
                pairs[busy].append((len(texts) - 2, len(texts) - 1))
                if busy:
                    texts += [" ".join(words(rng, 40) + passage[k : k + 16] + words(rng, 40)) for k in range(0, 44, 11) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found, reps = passages.repeated_passages(docs)
    ids = reps.select("th", "doc_id")
    met = found.join(ids, "th").join(ids.select(F.col("th").alias("src"), F.col("doc_id").alias("source")), "src").select("doc_id", "source").collect()
    got = {tuple(sorted(r)) for r in met}
    for wanted in pairs.values():
        assert sum(p in got for p in wanted) >= 0.9 * len(wanted)
    planted = {p for wanted in pairs.values() for p in wanted}
    assert all(longest_common(texts[a].split(), texts[b].split()) >= 32 for a, b in got - planted)


def test_passages_of_busy_pieces(spark):
    """Planted passages of 60 words, all pieces of one side quoted by 10 or 20 other texts: identity of 0.8 and more is found."""
    rng = random.Random(11)
    texts: list[str] = []
    pairs: dict[tuple, list[tuple[int, int]]] = {}
    for probe in ((16, 16, 10, 0.1), (16, 12, 20, 0.13), (12, 6, 20, 0.1), (16, 4, 10, 0.13)):
        size, every, quoters, share = probe
        pairs[probe] = []
        while len(pairs[probe]) < 15:
            passage = words(rng, 60)
            copy = changed(rng, passage, share)
            if longest_common(passage, copy) < 50:
                continue
            texts.append(" ".join(words(rng, 60) + passage + words(rng, 40)))
            texts.append(" ".join(words(rng, 50) + copy + words(rng, 70)))
            pairs[probe].append((len(texts) - 2, len(texts) - 1))
            texts += [" ".join(words(rng, 40) + passage[k : k + size] + words(rng, 40)) for k in range(0, 61 - size, every) for _ in range(quoters)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found, reps = passages.repeated_passages(docs)
    ids = reps.select("th", "doc_id")
    met = found.join(ids, "th").join(ids.select(F.col("th").alias("src"), F.col("doc_id").alias("source")), "src").select("doc_id", "source").collect()
    got = {tuple(sorted(r)) for r in met}
    for wanted in pairs.values():
        assert sum(p in got for p in wanted) >= 0.9 * len(wanted)


def test_passages_whose_seeds_a_common_source_has(spark):
    """All seeds of a passage of two texts are those of two pieces that 12 other texts quote at the same distance."""
    rng = random.Random(21)
    texts: list[str] = []
    pairs = []
    for _ in range(8):
        one, two, gap, tail = words(rng, 10), words(rng, 10), words(rng, 10), words(rng, 12)
        other = [[w if k % 4 else words(rng, 1)[0] for k, w in enumerate(x)] for x in (gap, tail)]
        texts.append(" ".join(words(rng, 50) + one + gap + two + tail + words(rng, 50)))
        texts.append(" ".join(words(rng, 60) + one + other[0] + two + other[1] + words(rng, 40)))
        pairs.append((len(texts) - 2, len(texts) - 1))
        texts += [" ".join(words(rng, 50) + one + words(rng, 10) + two + words(rng, 50)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found, reps = passages.repeated_passages(docs)
    ids = reps.select("th", "doc_id")
    met = found.join(ids, "th").join(ids.select(F.col("th").alias("src"), F.col("doc_id").alias("source")), "src").select("doc_id", "source").collect()
    assert {tuple(sorted(r)) for r in met} >= set(pairs)


def test_parts_of_a_frequent_seed_meet(spark, monkeypatch):
    """However many texts have a seed, an open place is compared with those of all texts of smaller hash."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(passages, "COMPARED", 64)
    monkeypatch.setattr(passages, "BLOCK", 256)
    n, side = 300, passages.SIDE + passages.DRIFT
    words_ = rng.integers(1, 256, (2 * side, n)).astype(np.uint8)
    words_[side : side + 10] = 7  # the seed's own words
    words_[:, 250] = words_[:, 40]
    words_[:, 260] = words_[:, 120]
    closed, prior = np.arange(n) == 260, np.zeros(n, np.int64)
    got = lambda part: {(int(b), int(a)) for x, y in passages.rest_pairs(np.arange(n), part, closed, prior, words_) for b, a in zip(x, y, strict=True)}
    assert got(np.zeros(n, np.int64)) == {(250, 40)} == got((np.arange(n) < 100).astype(np.int64)) and not got((np.arange(n) % 100 < 5).astype(np.int64))


def test_a_frequent_line_is_not_compared_in_all_pairs(monkeypatch):
    """Of 4,000 places of a line, those of one passage are found, with changed and moved words too, and few others are compared."""
    rng = np.random.default_rng(9)
    n, side = 4000, passages.SIDE + passages.DRIFT
    often = 1 / np.arange(10, 30010)
    words_ = (100 + rng.choice(30000, (2 * side, n), p=often / often.sum())).astype(np.uint16)
    words_[side - 3 : side + 12] = np.arange(1, 16)[:, None]
    planted = [(3000 + k, 40 * k) for k in range(50)]
    for b, a in planted:
        words_[:, b] = words_[:, a]
        words_[side + 20 : side + 30, b] = words_[side + 19 : side + 29, a]  # a word more
        words_[side - 38 : side - 3 : 7, b] = 60000 + np.arange(5)  # others changed
    compared, real = [], passages.passable
    monkeypatch.setattr(passages, "passable", lambda a, b: compared.append(a.shape[1]) or real(a, b))
    none = np.zeros(n, np.int64)
    found = {(int(b), int(a)) for x, y in passages.rest_pairs(np.arange(n), none, none > 0, none, words_) for b, a in zip(x, y, strict=True)}
    assert found >= set(planted) and sum(compared) < n * n // 40


def test_each_shared_pair_of_seeds_has_a_source(monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 50)
    rng = np.random.default_rng(3)
    for _ in range(20):
        th = np.sort(rng.integers(0, 60, 80))
        row, key = np.array(sorted({(r, k) for r in range(80) for k in rng.integers(0, rng.choice([6, 60]), 5).tolist()})).T
        got = [(a, b) for e, s in passages.pairs_of(th, row, key) for a, b in zip(e.tolist(), s.tolist(), strict=True)]
        assert all(key[a] == key[b] and th[row[b]] < th[row[a]] for a, b in got)
        for e in range(len(row)):
            before = {int(th[row[s]]) for s in range(len(row)) if key[s] == key[e] and th[row[s]] < th[row[e]]}
            mine = {int(th[row[b]]) for a, b in got if a == e}
            few = len({int(th[row[s]]) for s in range(len(row)) if key[s] == key[e]}) <= passages.RARE
            assert mine == before if few else bool(mine) == bool(before)


def test_heavy_seeds_have_the_same_sources(spark, monkeypatch):
    rng = random.Random(8)
    common = words(rng, 50)
    texts = [" ".join(words(rng, 50) + common + words(rng, 50)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = lambda: Counter(map(tuple, passages.repeated_passages(docs)[0].select("th", "src", "begin", "end").collect()))
    plain = rows()
    monkeypatch.setattr(passages, "HEAVY_LEAST", 2)
    monkeypatch.setattr(passages, "LOW", 4)
    assert len(passages.heavy_seeds(docs)[0]) > 10
    heavy = rows()
    assert {x[0] for x in plain} == {x[0] for x in heavy} and len({x[0] for x in heavy}) == 399


def test_cut_keeps_short_null_and_clashing_rows(spark):
    rng = random.Random(9)
    passage, own = words(rng, 60), words(rng, 50)
    rows = [(1, " ".join(passage + own), 0, "a"), (2, " ".join(words(rng, 50) + passage), 0, "b"), (3, None, 0, "c"), (4, "short", 0, "d"), (5, "short", 0, "e"), (6, " ".join(passage + own), 0, "f"), (6, " ".join(passage + own), 0, "f")]
    out = passages.cut_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, cuts string")).collect()
    assert Counter(r["doc_id"] for r in out) == Counter([1, 2, 3, 4, 5])
    assert sum(len(WORD.findall(r["text"] or "")) for r in out if r["doc_id"] in (1, 2)) in range(155, 166)


def test_threshold_search_skips_blocks_and_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "GROUP", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 12)) * 2
    x = np.concatenate([c + rng.normal(size=(100, 12)) * 0.1 for c in centres])
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    hits = topk.all_hits(vectors, F.col("vec_id") % 50 == 0).cache()
    assert hits.agg(F.sum("scored")).first()[0] < 0.5 * 40 * 2000
    q = np.floor(256 * x).astype(np.int64)
    want = {(k, n + 1, v, -s) for k in range(0, 2000, 50) for n, (s, v) in enumerate(sorted((-int(q[k] @ q[v]), v) for v in range(2000) if v != k)[:5])}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk._best(hits).collect()} == want


def vector_sets():
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, d = 4096, 64
    return {
        "tight cluster": (0.1, unit(rng.normal(size=(1, d))) + rng.normal(size=(n, d)) * 0.01),
        "norms of a log-normal": (0.6, unit(rng.normal(size=(n, d))) * rng.lognormal(size=(n, 1))),
        "few heavy dimensions": (0.3, rng.normal(size=(n, d)) * 0.7 ** np.arange(d)),
        "eight clusters": (0.75, unit(rng.normal(size=(8, d)))[rng.integers(0, 8, n)] + rng.normal(size=(n, d)) * 0.01),
        "no structure": (1.0, unit(rng.normal(size=(n, d)))),
        "equal vectors": (1.0, np.ones((n, d))),
    }


@pytest.mark.parametrize("name", sorted(vector_sets()))
def test_walks_stop_inside_a_block_of_64_dimensions(name):
    most, x = vector_sets()[name]
    q, ids, asked = np.floor(256 * x).astype(np.int64), np.arange(len(x)), np.arange(0, len(x), 50)
    best = topk.Best(np.full(len(asked), topk.NONE))
    scored = topk.threshold_search(q[asked], asked, topk.block_of(ids, q), best)
    assert scored <= most * len(asked) * len(x)
    full = q[asked] @ q.T
    full[np.arange(len(asked)), asked] = topk.NONE
    want = [sorted(zip((-f).tolist(), ids.tolist(), strict=True))[:5] for f in full]
    assert [[(-s, v) for s, v in zip(a.tolist(), b.tolist(), strict=True)] for a, b in zip(best.score, best.id, strict=True)] == want


def test_clustered_vectors_of_64_dimensions_are_scored_in_part(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64))
    x = (centres / np.linalg.norm(centres, axis=1, keepdims=True))[np.arange(8192) % 8] + rng.normal(size=(8192, 64)) * 0.01
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = topk.all_hits(vectors, F.col("vec_id") % 50 == 0).cache()
    assert hits.agg(F.sum("scored")).first()[0] < 0.2 * 164 * 8192
    q = np.floor(256 * x).astype(np.int64)
    want = {(k, n + 1, v, -s) for k in range(0, 8192, 50) for n, (s, v) in enumerate(sorted((-int(s), v) for v, s in enumerate(q @ q[k]) if v != k)[:5])}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk._best(hits).collect()} == want


def test_blocks_with_components_at_the_ends_of_a_long():
    rng = np.random.default_rng(4)
    q = np.where(rng.random((600, 9)) < 0.3, 2**62, rng.integers(-(2**61), 2**61, (600, 9)))
    best = topk.Best(np.full(12, topk.NONE))
    topk.threshold_search(q[::50], np.arange(0, 600, 50), topk.block_of(np.arange(600), q), best)
    for k, row in enumerate(q[::50]):
        exact = np.clip(row.astype(object) @ q.T.astype(object), topk.LEAST, topk.MOST)
        want = sorted((-int(s), v) for v, s in enumerate(exact) if v != 50 * k)[:5]
        assert [(-s, v) for s, v in zip(best.score[k].tolist(), best.id[k].tolist(), strict=True)] == want


def test_products_beyond_a_double_are_exact():
    big = np.array([[2**40 + 1, 2**40 - 1]], np.int64)
    assert topk.products(big, big)[0, 0] == min(2**63 - 1, (2**40 + 1) ** 2 + (2**40 - 1) ** 2)
    odd = np.array([[2**30 + 1, 3]], np.int64)
    assert topk.products(odd, odd)[0, 0] == (2**30 + 1) ** 2 + 9


def fair_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full: set = set()
    while True:
        rest = [s for s in order if s not in full]
        level = (sum(sizes.values()) - 3 * sum(sizes[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def test_mix_equals_a_plain_queue(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(words(rng, rng.choice((1, 5, 40, 700)))), rng.choice(["a", "b", "b", "b", "b", "c", "é", None])) for k in range(300)]
    rows += [(7, "a b c", None), (7, None, "a b c"), (9, "p q", "a"), (9, "p q", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), mixing.identity("doc_id", "source", "text").alias("_k"), F.xxhash64(F.lit(mixing.SEED), mixing.identity("doc_id", "source", "text")).alias("h"))
    each = sorted(((r["source"] is None, (r["source"] or "").encode(), r["h"], bytes(r["_k"]), r["source"], r["size"]) for r in keyed.collect()), key=lambda x: x[:4])
    sizes = Counter()
    for *_, source, size in each:
        sizes[source] += size
    target = fair_targets(dict(sizes))
    packets, ahead, nth = [], Counter(), Counter()
    for *_, k, source, size in each:
        before, ahead[source] = ahead[source], ahead[source] + size
        nth[k] += 1
        for epoch in range(3):
            start = before + epoch * sizes[source]
            if size and start < target[source]:
                step = -(-size // mixing.PACKETS) if start + size > target[source] else size
                key = "~" if source is None else "=" + source
                packets += [((start + f + min(step, size - f)) / target[source], key.encode(), k, nth[k], epoch, f, min(step, size - f), source) for f in range(0, size, step)]
    left, want, by_source = sum(sizes.values()), Counter(), Counter()
    for _, _, k, _, _, _, n, source in sorted(packets):
        want[k] += min(n, left)
        by_source[source] += min(n, left)
        left -= min(n, left)
    got, shares = Counter(), {}
    for r in mixing.sequence(mixing.queue(keyed.drop("h"))).collect():
        got[bytes(r["_k"])] += r["words"]
        shares[r["source"]] = r["target"]
    assert +got == +want
    assert all(abs(shares[s] - target[s]) < 1e-6 for s in shares)
    assert all(abs(by_source[s] - target[s]) <= 10 for s in target)


def tfidf_best(text: str, idf: dict[str, float], none: float) -> tuple[str, float]:
    low = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
    vector = lambda t: {w: n * idf.get(w, none) for w, n in Counter(low(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    mine = vector(text)
    scores = []
    for name, template in licenses.templates():
        other = vector(template)
        scores.append((sum(x * other.get(w, 0.0) for w, x in mine.items()) / (norm(mine) * norm(other) or 1), name))
    best = max(s for s, _ in scores)
    return next((n, s) for s, n in scores if abs(s - best) < 1e-12)


def test_cosine_equals_plain_tfidf():
    terms = {w for _, t in licenses.templates() for w in re.findall(r"[0-9a-z]+", t.lower())}
    known, _ = licenses.vocabulary()
    rng = random.Random(3)
    idf = np.ones(len(known) + 1)
    by_word = {}
    for w in sorted(terms):
        at = licenses._places(known, licenses.terms(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1])[0]
        by_word[w] = idf[at] = 1 + rng.random() * 4
    idf[-1] = 6.0
    texts = ["Released under the MIT License.", "some prose about rivers and licences", " ".join(licenses.templates()[12][1].split()[:60]), licenses.templates()[-1][1][:3000], "Licensed under the Apache License, Version 2.0 and more words here"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    best, cosine = licenses.best_template(data, bounds, idf, licenses.template_lists(idf))
    for k, text in enumerate(texts):
        name, score = tfidf_best(text, by_word, 6.0)
        assert abs(cosine[k] - score) < 1e-9 and (licenses.templates()[best[k]][0] == name or score == 0)


def test_wrapped_headers_and_clashing_names(spark):
    gpl = "\n".join(f" * {x}" for x in ("This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."))
    files = [("p/a.c", f"/*\n{gpl}\n */\nint main() {{ return 0; }}\n", 1, 2, 3), ("p/LICENSE", licenses.templates()[-1][1], 1, 2, 3), ("p/q/b.c", "int b;", 1, 2, 3), ("p/c.c", "// SPDX-License-Identifier: MIT OR Apache-2.0\n", 1, 2, 3)]
    out = licenses.scan(spark.createDataFrame(files, "path string, text string, Cosine int, _near int, _dir int"))
    assert {"_near", "_dir"} <= set(out.columns) and "Cosine" not in out.columns
    assert {r["path"]: r["licence"] for r in out.collect()} == {"p/a.c": "GPL-3.0", "p/LICENSE": "MPL-2.0", "p/q/b.c": "MPL-2.0", "p/c.c": "MIT OR Apache-2.0"}


def test_index_merges_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "MERGE_ROWS", 40)
    rng = random.Random(4)
    rows = [(f"a{k % 3}", k, rng.randrange(500) if k % 50 else None, rng.choice([None, "http://b.example/x?z=1&a=2", "http://www.a.example/"]), f"2024-01-0{rng.randrange(1, 9)}") for k in range(300)]
    captures = spark.createDataFrame(rows, "archive string, position long, page_id long, url string, captured string").repartition(4)
    got = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in warc.merged_index(captures).collect()]
    assert len(got) == 300 and got == sorted(got)


def test_loser_tree_merges_any_lists():
    rng = random.Random(5)
    for k in range(1, 9):
        lists = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 12))) for _ in range(k)]
        assert [lists[a][b] for a, b in warc.LoserTree(lists)] == sorted(x for y in lists for x in y)


def test_chat_pieces_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_BYTES", 300)
    monkeypatch.setattr(chat, "HELD_BYTES", 2000)
    rows = [(c, t, "assistant" if t % 2 else "user", f"{'é' * (t % 40)} </s> {c} {t}") for c, n in ((1, 400), (2, 3), (3, 1), (4, 150)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: r for r in chat.formatted_digests(turns).collect()}
        same = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == same and len(got) == 4
    for c in got:
        mine = [(r, x) for k, t, r, x in sorted(rows) if k == c]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        assert got[c]["loss_chars"] == sum(len(x) for r, x in mine if r == "assistant")


def test_quality_replaces_and_carries_names_in_any_case(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40)), 5, "x")], "doc_id long, text string, N_Words int, KEPT string")
    assert quality.with_measures(docs).columns.count("n_words") == 1
    assert quality.filter_quality(docs).collect()[0].asDict()["N_Words"] == 5


def test_texts_of_megabytes(spark):
    rng = random.Random(12)
    long = " ".join(words(rng, 400_000, 50_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, long + " x", "en"), (3, "short text", "en")], "doc_id long, text string, source string")
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3}
    assert quality.with_measures(docs).where("doc_id = 1").first()["n_words"] == 400_000
    path, pattern = bpe.byte_bpe_50k()
    ids = bpe.with_ids(docs.where("doc_id = 1"), path, pattern).first()["token_ids"]
    assert bpe.decode(pa.array([ids], pa.list_(pa.int32())), path)[0].as_py() == long.encode()
    kept = {r["doc_id"]: len(WORD.findall(r["text"])) for r in passages.cut_documents(docs).collect()}
    assert sorted(kept.values())[0] == 2 and sum(kept.values()) < 400_100


def test_pipeline_equals_brute_force_stage_by_stage(spark, tmp_path):
    rng = random.Random(21)
    texts = [" ".join(words(rng, rng.randrange(12, 90))) for _ in range(60)]
    texts += [" ".join(changed(rng, t.split(), 0.01)) for t in texts[:15]] + texts[:5] + ["few words", "", None, "the same " * 40]
    rows = [(k, t, "en", rng.choice(["a", "b", None]), len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = {r["doc_id"] for r in stages["quality_rules"](spark, docs, str(tmp_path)).collect()}

    def verdict(text: str | None) -> bool:
        w = WORD.findall(text or "")
        chars = sum(map(len, w))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        again = sum(sum(map(len, WORD.findall(x))) for k, x in enumerate(lines) if x in lines[:k])
        shares = {}
        for n in {5, *quality.COVERAGE}:
            grams = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            shares[n] = {k + j for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] > 1 for j in range(n)}
        base = len(w) >= 10 and 100 * len(shares[5]) <= 20 * len(w)
        return base and 100 * again <= 25 * chars and all(100 * sum(len(w[k]) for k in shares[n]) <= most * chars for n, most in quality.COVERAGE.items())

    assert good == {k for k, t in enumerate(texts) if verdict(t)}
    left = sorted(good)
    classes = brute_classes([texts[k] for k in left])
    kept = {r["doc_id"] for r in stages["jaccard_join"](spark, docs.where(F.col("doc_id").isin(left)), str(tmp_path)).collect()}
    assert kept == {left[c] for c, _, _ in classes}
    out = corpus_pipeline.run(spark, str(tmp_path))
    path, _ = bpe.byte_bpe_50k()
    assert "text" not in out.columns
    decoded = {(r["doc_id"], b.as_py().decode()) for r in out.collect() for b in bpe.decode(pa.array([r["token_ids"]], pa.list_(pa.int32())), path)}
    assert {k for k, _ in decoded} <= kept
    assert all(" ".join(t.split()) in " ".join(texts[k].split()) for k, t in decoded)
    total = sum(len(WORD.findall(t)) for r in out.collect() for t in [bpe.decode(pa.array([r["token_ids"]], pa.list_(pa.int32())), path)[0].as_py().decode()])
    assert total == sum(len(WORD.findall(texts[k])) for k in kept)
