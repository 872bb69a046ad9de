"""Vector codes, shards and phrases against plain Python and DuckDB, with the defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auspex.llm import codes, phrases, registry, sharding
from auspex.sources.shared import materialize

NAN = float("nan")
VECTORS = [(k, [((k * 37 + j * 11) % 101 - 50) / 64 for j in range(10)], k % 3 if k % 5 else None, "x") for k in range(700)]
VECTORS += [VECTORS[3], VECTORS[3], (900, None, 1, "x"), (901, [1.0, None] + [0.0] * 8, 1, "x"), (902, [NAN] * 10, 1, "x"), (903, [float("inf")] * 10, 1, "x"), (None, [0.1] * 10, None, "x"), (905, [], 2, "x"), (906, [3.0, -4.0, 1e6], 2, "x"), (907, [3.1, -4.0, 1e6], 2, "x")]
VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain_codes(rows):
    """(vec_id, code, error, label_error, digest) of each row."""
    kept = [(i, [floor(1024 * float(np.float32(v))) for v in x], label) for i, x, label, _ in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out, errors = [], Counter()
    for dims in {len(r[1]) for r in kept}:
        own = [r for r in kept if len(r[1]) == dims]
        edges = [(dims * p // 4, dims * (p + 1) // 4) for p in range(4)]
        books = [[r[1][a:b] for r in own[:256]] for a, b in edges]

        def assign():
            return [[min((sum((v - w) ** 2 for v, w in zip(r[1][a:b], e)), k) for k, e in enumerate(book)) for (a, b), book in zip(edges, books)] for r in own]

        for _ in range(4):
            found = assign()
            for p, (a, b) in enumerate(edges):
                parts = defaultdict(list)
                for r, f in zip(own, found):
                    parts[f[p][1]].append(r[1][a:b])
                for k, x in parts.items():
                    books[p][k] = [sum(c) // len(x) for c in zip(*x)]
        digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
        for r, f in zip(own, assign()):
            out.append((r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), r[2], digest))
            errors[r[2]] += out[-1][2]
    return Counter((i, c, e, errors[label], d) for i, c, e, label, d in out)


def test_codes_equal_plain_rounds(spark, tmp_path):
    spark.createDataFrame(VECTORS, VECTOR_SCHEMA).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = registry.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in found) == plain_codes(VECTORS)


def test_codes_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], VECTOR_SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("scale", [3, 1000, 2**20, 2**40])
def test_partial_distances_find_the_first_nearest(scale):
    rng = np.random.default_rng(scale)
    book = rng.integers(-scale, scale, (256, 16)) * (rng.random(16) < 0.7)
    book[200] = book[7]
    x = np.concatenate([rng.integers(-scale, scale, (300, 16)), book[[7, 200, 0]]])
    entry, distance = codes.nearest(x, book)
    exact = [[sum(int(a - b) ** 2 for a, b in zip(v, e)) for e in book] for v in x]
    assert entry.tolist() == [d.index(min(d)) for d in exact]
    assert distance.tolist() == [min(d) for d in exact]


def test_masks_drop_entries_before_the_last_dimension(monkeypatch):
    rng = np.random.default_rng(5)
    book = rng.integers(-1000, 1000, (256, 16))
    seen = []
    plain = codes._completed
    monkeypatch.setattr(codes, "_completed", lambda x, book, row, entry, partial, depth: seen.append(depth) or plain(x, book, row, entry, partial, depth))
    x = book[rng.integers(0, 256, 500)] + rng.integers(-5, 5, (500, 16))
    codes.nearest(x, book)
    assert seen == [4]  # vectors near an entry: after four dimensions nothing else is left


def test_codes_are_read_back(spark):
    rows = codes.quantized(spark.createDataFrame(VECTORS[:300], VECTOR_SCHEMA).select("vec_id", "embedding", "label"))
    books = codes.fitted(rows)
    found = codes.decoded(codes.coded(rows, books), books, 10).join(rows.withColumnRenamed("q", "own"), "vec_id").collect()
    assert len(found) == 300
    assert all(sum((a - b) ** 2 for a, b in zip(r["q"], r["own"])) == r["error"] for r in found)


def plain_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_plain_walk_and_moves_into_the_new_shard_only():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(k, n) for k in keys.tolist()]
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(after[before != after]) == {24}
    assert 0.02 < (before != after).mean() < 0.06


DOCS = [(k, t, "s") for k, t in enumerate([None, "", "é漢" * 900, "x" * 2_000_000, "a b"] * 40)] + [(7, "same", "s")] * 300 + [(7, None, "s"), (None, "n", "s"), (None, None, "s")]


def test_shards(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, shard string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["op12_sharding"](spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, size(t) + 8, zlib.crc32((t or "").encode())) for i, t, _ in DOCS)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        shards[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())


def test_shards_are_written_and_grow(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", "s") for k in range(500)], "doc_id long, text string, Shard string")
    sharding.write_shards(docs, str(tmp_path / "out"), 6, file_rows=20)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == 500 and read.select("shard").distinct().count() == 6
    gone = sharding.moved(docs, 6, 8)
    assert {r["to_shard"] for r in gone.collect()} <= {6, 7}
    stay = read.join(gone, "doc_id", "left_anti").select("doc_id", "shard").collect()
    again = {r["doc_id"]: r["s"] for r in docs.select("doc_id", sharding.shard_of(F.col("doc_id"), 8).alias("s")).collect()}
    assert stay and all(again[r["doc_id"]] == r["shard"] for r in stay)


def plain_phrases(docs, least=30, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, n, p, a, l, r, total[lang], score) for n, (score, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def phrase_docs(seed: int, n: int) -> list[tuple[str | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["Stone", "river", "é", "漢字", "a", "A", "the", "new\x0byork", " ", "x" * 300, "co-op", "river\tbank"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "!?"]) for _ in range(rng.randrange(0, 60)))
    docs = [(text(), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(n)]
    return [*docs, (None, "en"), ("", "fr"), (" .,;", None), ("new york city hall " * 40, "de"), ("new york city hall, " * 40, "de"), ("a a a a a " * 30, "fr"), ("solo", "xx")]


@pytest.mark.parametrize("block,rows", [(8 << 20, 1_000_000), (500, 3)])
def test_phrases_equal_plain_counts(spark, monkeypatch, block, rows):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", rows)
    docs = phrase_docs(3, 400)
    found = phrases.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(5)).collect()
    assert sorted(tuple(r) for r in found) == plain_phrases(docs)


def test_phrases_of_a_very_long_text_and_none(spark):
    docs = [("north wind and sun. " * 200_000, "en"), ("quiet", "en")]
    found = phrases.collocations(spark.createDataFrame(docs, "text string, lang string")).collect()
    assert [(r["phrase"], r["a"], r["score"]) for r in found] == [("north wind and sun", 200_000, 1_000_000)]
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    a, l, r = 2**61 + 1, 2**62 + 5, 2**61 + 9
    row = spark.createDataFrame([(a, [l], [r])], "f long, first array<long>, rest array<long>")
    assert row.select(phrases.cut_score("first", "rest", "f")["score"]).first()[0] == 2000000 * a // (l + r)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_sharding", "op13_phrases"])
def test_sql_agrees(spark, name):
    home = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{home}/{t}.parquet')")
    told = con.execute(registry.ORACLES[name])
    found = registry.QUERIES[name](spark, home)
    order = [found.columns.index(c[0]) for c in told.description]
    assert Counter(tuple(r[k] for k in order) for r in found.collect()) == Counter(told.fetchall())


def test_tasks_of_phrases_hold_few_blocks(spark, monkeypatch):
    """The blocks of a task don't grow with the input."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 16)
    docs = spark.createDataFrame([(f"one two three four five {k}", "en") for k in range(120)], "text string, lang string").repartition(2)
    lists = materialize(phrases.word_lists(docs, "text", "lang"), "word-lists")
    found = materialize(phrases.frequent(lists, ["grp", "word"], 30), "frequent-words")
    longer = phrases.phrase_lists(lists, phrases.joined_back(lists, found, ["grp", "word"]))
    assert lists.count() == 120 and longer.rdd.getNumPartitions() >= 120 // phrases.TASK_BLOCKS
    assert longer.select(F.explode("n").alias("n")).agg(F.sum("n")).first()[0] == 4 * 120


def test_keys_of_blocks_travel_packed(spark, monkeypatch):
    """A block has one row for each bucket, not one for each of its frequent keys; sums over buckets of one key or many are the same."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 16)
    docs = spark.createDataFrame([(f"one two three four five {k}", "en") for k in range(120)], "text string, lang string").repartition(2)
    lists = materialize(phrases.word_lists(docs, "text", "lang"), "word-lists")
    found = materialize(phrases.frequent(lists, ["grp", "word"], 30), "frequent-words")
    assert phrases.joined_back(lists, found, ["grp", "word"]).count() == 120
    expected = sorted(map(tuple, phrases.collocations(docs).collect()))
    monkeypatch.setattr(phrases, "BUCKET", 7)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == expected and expected


def test_numbers_of_keys_are_exact_beyond_32_bits():
    columns = [pa.array([0, 1 << 40, 0, 1 << 40, 5]), pa.array([1 << 50, 0, 1 << 50, 1, 0])]
    numbers = phrases.joint(columns).tolist()
    assert numbers[0] == numbers[2] and len(set(numbers)) == 4
    assert len(set(phrases.joint([pa.array(["a", "b", "a"]), pa.array(["x", "x", "y"])]).tolist())) == 3
