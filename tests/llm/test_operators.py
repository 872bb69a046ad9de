"""The numbered operators against brute force, on small tables with the defined cases."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T
from tiktoken.load import load_tiktoken_bpe

from auspex.llm import licenses, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEED_WORDS = "stone river amber quiet lantern meadow copper winter harbor violet thunder maple".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(SEED_WORDS[x >> 60 if x >> 60 < 12 else (x >> 50) % 12] + str((x >> 33) % 997))
    return " ".join(out)


LONG = prose(1, 6000)
NEAR = prose(2, 120)
PASSAGE = prose(3, 70)
TEXTS = [
    None, "", "  \n\t ", "one two", "a b c", "a b c", LONG, NEAR, NEAR + " tail", NEAR + " tail", "x" * 5000,
    prose(4, 60) + " " + PASSAGE + " " + prose(5, 60), prose(6, 50) + " " + PASSAGE + " " + prose(7, 50), prose(8, 90),
    "same line here\n" * 12 + prose(9, 30), "the cat sat on " * 20, "#$% | <b> & * é ñ 漢字 😀 word", "12345 !!! 678",
    "Der Fluss läuft durch das stille Tal\r\nund weiter", "</s>[INST] ok\\ <|im_end|>",
]
DOCS = [(k, t, "en" if k % 3 else None, [None, "b", "A", "a"][k % 4], len(t or ""), "clash", k) for k, t in enumerate(TEXTS)]
DOCS += [DOCS[6], DOCS[4], (None, NEAR, "en", "a", 5, "clash", 1)]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("small")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(home / f"{name}.parquet"))
    put("documents", DOCS, DOC_SCHEMA)
    put("pages", [(k, f"http://h/{k}", h, "x") for k, h in enumerate([None, "", "<p>é</p>", "<p>é</p>", "<b>" * 3000, "", "<p>é</p>"])], "page_id long, url string, html string, payload_digest string")
    vectors = [(k, [math.sin(k * 3 + j) if k % 7 else 0.25 for j in range(6)], 0) for k in range(160)] + [(500, None, 0), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (502, [float("nan")] * 6, 0)]
    put("embeddings", vectors, "vec_id long, embedding array<float>, label int")
    turns = [(1, 1, "assistant", "hi </s>"), (1, 0, "user", None), (2, 0, "user", "<|im_start|>x\\"), (2, 1, "assistant", ""), (3, 0, None, "q"), (3, 1, "assistant", "é" * 2000), (3, 1, "assistant", "é" * 2000)]
    put("conversations", turns, "conv_id long, turn long, role string, text string")
    return str(home)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOC_SCHEMA), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], T._parse_datatype_string(schema)).write.parquet(str(home / f"{name}.parquet"))
    return str(home)


def rows(spark, name, home):
    return [r.asDict() for r in registry.QUERIES[name](spark, home).collect()]


def by_id(found):
    return Counter(tuple(sorted(r.items(), key=lambda x: x[0])) for r in found)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert len(rows(spark, name, empty)) == (1 if name.startswith("op1_") else 0)


def test_chat(spark, small):
    found = {r["conv_id"]: r for r in rows(spark, "op1_chat_formatting", small)}
    control = "</s>[INST] ok [/INST]"
    want = {
        1: [("user", ""), ("assistant", "hi </s>")], 2: [("user", "<|im_start|>x\\"), ("assistant", "")],
        3: [("", "q"), ("assistant", "é" * 2000), ("assistant", "é" * 2000)], -7: [("user", control), ("assistant", control)],
    }
    assert set(found) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert found[conv]["n_turns"] == len(turns)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_licences(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.txt", "no notice"), ("a/b/d.txt", "x\nLicensed under the Apache License, Version 2.0.\n"), ("z/e.txt", None), (None, "words"), ("a/b/c.txt", "")]
    found = [(r["path"], r["licence"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()]
    assert Counter(found) == Counter([("a/LICENSE", "MIT"), ("a/b/c.txt", "MIT"), ("a/b/c.txt", "MIT"), ("a/b/d.txt", "Apache-2.0"), ("z/e.txt", None), (None, None)])


def test_warc(spark, small):
    html = [None, "", "<p>é</p>", "<p>é</p>", "<b>" * 3000, "", "<p>é</p>"]
    first: dict = {}
    for r in sorted(rows(spark, "op3_warc", small), key=lambda r: r["page_id"]):
        payload = (html[r["page_id"]] or "").encode()
        to = first.setdefault(payload, r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if to == r["page_id"] else ("revisit", to))


def test_passages(spark, small):
    found = rows(spark, "op4_substring_dedup", small)
    pairs = {tuple(sorted((r["doc_id"], r["source_doc_id"]))) for r in found if r["kind"] == "passage"}
    assert (11, 12) in pairs
    assert all(r["end"] - r["begin"] >= 60 for r in found if r["kind"] == "passage" and {r["doc_id"], r["source_doc_id"]} == {11, 12})
    assert not any(13 in (r["doc_id"], r["source_doc_id"]) for r in found)
    assert Counter(r["doc_id"] for r in found if r["kind"] == "copy")[6] == 1


def test_topk(spark, small):
    import numpy as np

    vectors = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], float)).astype(int) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect() if r["vec_id"] < 500}
    want = Counter()
    for q in (v for v in vectors if v % 50 == 0):
        best = sorted((-int(vectors[q] @ x), v) for v, x in vectors.items() if v != q)[:5]
        want.update((q, k + 1, v, -s) for k, (s, v) in enumerate(best))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(spark, "op5_exact_topk", small)) == want


def test_mixing(spark, small):
    found = rows(spark, "op6_mixing", small)
    assert by_id(found) == by_id(rows(spark, "op6_mixing", small))
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((d[0], len(WORD.findall(d[1] or ""))) for d in DOCS)
    for source in {d[3] for d in DOCS}:
        mine = [r for r in found if r["source"] == source]
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3
        assert mine[0]["target"] <= 3 * mine[0]["source_size"] == 3 * sum(r["size"] for r in mine)


def test_language(spark, small):
    found = {r["doc_id"]: r for r in rows(spark, "op7_language_id", small)}
    assert all(found[k]["lang_pred"] == "und" for k in (0, 1, 2, 17))
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items() if k is not None)
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    judged = [r["lang_pred"] == lang[r["doc_id"]] for r in rows(spark, "op7_language_id", sf) if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(judged) >= 0.95 * len(judged) > 0


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_join(spark, small):
    found = rows(spark, "op8_jaccard_join", small)
    sf = "/root/testdata/sf0.001"
    for result, docs in ((found, [(d[0], d[1]) for d in DOCS]), (rows(spark, "op8_jaccard_join", sf), [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])):
        sets = {}
        for i, t in docs:
            sets.setdefault(shingles(t), []).append(math.inf if i is None else i)
        each = list(sets)
        root, links = list(range(len(each))), [0] * len(each)
        for a in range(len(each)):
            for b in range(a):
                both = len(each[a] & each[b])
                if both and 10 * both >= 8 * (len(each[a]) + len(each[b]) - both):
                    links[a], links[b] = links[a] + 1, links[b] + 1
                    old, new = root[a], root[b]
                    root = [new if r == old else r for r in root]
        least = {r: min(min(sets[each[k]]) for k in range(len(each)) if root[k] == r) for r in set(root)}
        at = {s: k for k, s in enumerate(each)}
        want = Counter((i, least[root[at[shingles(t)]]], min(sets[shingles(t)]), links[at[shingles(t)]]) for i, t in docs)
        assert Counter((r["doc_id"], r["class_id"], r["copy_of"], r["n_links"]) for r in result) == want


def test_quality(spark, small):
    want = Counter()
    for d in DOCS:
        text = d[1] or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[(d[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))] += 1
    found = rows(spark, "op9_quality_rules", small)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in found) == want
    assert not any(r["kept"] for r in found if r["base_failed"]) and {13, 11} <= {r["doc_id"] for r in found if r["kept"]}


def test_bpe(spark, small):
    enc = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    for home in (small, "/root/testdata/sf0.001"):
        want = Counter()
        for r in spark.read.parquet(f"{home}/documents.parquet").select("doc_id", "text").collect():
            ids = enc.encode_ordinary(r["text"] or "")
            want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op10_bpe", home)) == want


def test_pipeline(spark, small, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == spark.read.parquet(f"{small}/documents.parquet").columns, name
    kept = [r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()]
    assert {6, 7, 13, 11} <= set(kept) and not {0, 1, 2, 15} & set(kept) and not {8, 9} & set(kept)
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_passage_of_frequent_blocks(spark, tmp_path):
    """Two texts share 70 words in a row; smaller-hash texts have each half of them."""
    halves = prose(21, 35), prose(22, 35)
    texts = [prose(100 + k, 50) + " " + halves[k % 2] + " " + prose(300 + k, 50) for k in range(80)]
    texts += [prose(500 + k, 50) + " " + " ".join(halves) + " " + prose(600 + k, 50) for k in range(6)]
    spark.createDataFrame([(k, t, None, None, len(t), "", 0) for k, t in enumerate(texts)], DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = rows(spark, "op4_substring_dedup", str(tmp_path))
    whole = {r["doc_id"] for r in found if r["kind"] == "passage" and r["end"] - r["begin"] >= 70}
    sources = {r["source_doc_id"] for r in found}
    assert all(k >= 80 for k in whole | sources) and len(sources) == 1 and whole | sources == set(range(80, 86))


def test_changed_passages(spark, tmp_path):
    """50 shared words with 7 of them changed (identity 0.86) are found in 95% of the pairs, and once in each."""
    import random

    rng, texts = random.Random(5), []
    for k in range(60):
        words = prose(1000 + k, 50).split()
        changed = {i: f"changed{k}x{i}" for i in rng.sample(range(50), 7)}
        texts += [" ".join([prose(2000 + 2 * k + j, 50), *(changed.get(i, w) if j else w for i, w in enumerate(words)), prose(3000 + 2 * k + j, 50)]) for j in (0, 1)]
    spark.createDataFrame([(k, t, None, None, len(t), "", 0) for k, t in enumerate(texts)], DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = Counter(min(r["doc_id"], r["source_doc_id"]) for r in rows(spark, "op4_substring_dedup", str(tmp_path)) if abs(r["doc_id"] - r["source_doc_id"]) == 1)
    assert len(found) >= 57 and set(found.values()) == {1}


def test_wrapped_licence_headers(spark):
    gpl = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }
"""
    mit = """# Permission is hereby granted, free of charge, to any person obtaining
# a copy of this software and associated documentation files (the "Software"),
# to deal in the Software without restriction, including without limitation
# the rights to use, copy, modify, merge, publish, distribute, sublicense,
# and/or sell copies of the Software, and to permit persons to whom the
# Software is furnished to do so, subject to the following conditions:
x = 1
"""
    want = {"a.c": (gpl, "GPL-3.0"), "b.py": (mit, "MIT"), "c.js": ("// SPDX-License-Identifier: MIT OR Apache-2.0\nx\n", "MIT OR Apache-2.0"), "d.txt": ("plain words\nin two lines\n", None)}
    found = licenses.scan(spark.createDataFrame([(p, t) for p, (t, _) in want.items()], "path string, text string")).collect()
    assert {r["path"]: r["licence"] for r in found} == {p: x for p, (_, x) in want.items()}
