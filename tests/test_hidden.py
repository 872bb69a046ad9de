"""Runs of hidden code points, blobs of high entropy and places, by literal rows with near misses."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auspex.operators import positions, runs
from auspex.sources import manifests

FILES = "package_name string, file_path string, content string"


def hide(data: bytes) -> str:
    return "".join(chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in data)


def found_runs(spark, content):
    rows = runs.hidden_runs(spark.createDataFrame([("p", "f.js", content)], FILES)).collect()
    return sorted((r["line"], r["col"], r["n_points"], r["payload_class"], r["decoded"], r["severity"]) for r in rows)


@pytest.mark.parametrize(
    "content,want",
    [
        (None, []),
        ("", []),
        ("x" + hide(b"fifteen marks!!"), []),
        (hide(b"sixteen of them!"), [(1, 1, 16, "plaintext", "sixteen of them!", "critical")]),
        ("é\r\n😀 " + hide(b"eval(code);//more") + "b" + hide(b"0123456789abcdef") + "\n", [(2, 3, 17, "plaintext", "eval(code);//more", "critical"), (2, 21, 16, "plaintext", "0123456789abcdef", "critical")]),
        (hide(b"over a line end  ") + "\n" + hide(b"which parts a run"), [(1, 1, 17, "plaintext", "over a line end  ", "critical"), (2, 1, 17, "plaintext", "which parts a run", "critical")]),
        ("a\n\n" + hide(bytes([255] * 20)), [(3, 1, 20, "suspicious", None, "high")]),
        (hide(bytes(range(256))), [(1, 1, 256, "encrypted", None, "high")]),
    ],
)
def test_runs(spark, content, want):
    assert found_runs(spark, content) == want


def test_findings_of_runs(spark):
    files = spark.createDataFrame([("p", "f.js", "ab" + hide(b"sixteen of them!"))] * 2, FILES)
    rows = runs.run_findings(runs.hidden_runs(files)).collect()
    assert [(r["line"], r["col"], r["category"], r["severity"]) for r in rows] == [(1, 3, "stegano_payload", "critical")] * 2


def test_entropy_equals_a_histogram(spark):
    rng = random.Random(4)
    data = [b"", b"\0", b"aaaa", bytes(range(256)), *(bytes(rng.randrange(k) for _ in range(300)) for k in (2, 17, 256))]
    plain = lambda x: sum(-n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())
    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(data)], "k int, x binary").select("k", runs.byte_entropy(F.col("x")).alias("e")).collect()
    assert all(abs(r["e"] - plain(data[r["k"]])) < 1e-9 for r in rows)


CODE = base64.b64encode(hashlib.sha512(b"x").digest()).decode()
RUN_IT = "\neval(atob(a))"


@pytest.mark.parametrize(
    "content,path,line",
    [
        ("\n\nlet a = '" + CODE + "'" + RUN_IT, "src/a.js", 3),
        ("let a = \"" + CODE[:40] + "-" + CODE[40:63] + '"' + RUN_IT, "src/a.js", 1),
        ("let a = \"" + CODE[:40] + "-" + CODE[40:62] + '"' + RUN_IT, "src/a.js", None),
        ("x\nlet a = `" + CODE[:40] + " " + CODE[40:] + "`" + RUN_IT, "src/a.js", 2),
        ("let h = '" + "0123456789abcdef" * 4 + "'\nlet a = '" + CODE + "'" + RUN_IT, "src/a.js", 1),
        ("let a = '" + "abcdefgh-" * 9 + "'" + RUN_IT, "src/a.js", None),
        ("let a = '" + CODE + "'\neval(a)", "src/a.js", None),
        ("let a = '" + CODE + "'\natob(a)", "src/a.js", None),
        ("let a = '" + CODE + "'" + RUN_IT, "build/a.js", None),
        ("let a = '" + CODE + "'" + RUN_IT, "src/a.min.js", None),
        ("/* webpack */ let a = '" + CODE + "'" + RUN_IT, "src/a.js", None),
        ("let a = '" + CODE + "'" + "\n" * 5 + RUN_IT, "src/a.cjs", None),
        (None, "src/a.js", None),
    ],
)
def test_encrypted_payloads(spark, content, path, line):
    found = runs.encrypted_payloads(spark.createDataFrame([("p", path, content)], FILES))
    assert [r["line"] for r in found.collect()] == ([] if line is None else [line])
    assert [(r["line"], r["severity"]) for r in runs.payload_findings(found).collect()] == ([] if line is None else [(line, "high")])


def test_places(spark):
    rows = [("ab\ncd", "d"), ("ab\ncd", "ab"), ("é\n\n😀x", "x"), ("a", "b"), (None, "b"), ("", "")]
    got = spark.createDataFrame(rows, "t string, x string").select(positions.place_of(F.col("t"), F.col("x")).alias("p")).collect()
    assert [r["p"] and tuple(r["p"]) for r in got] == [(2, 2), (1, 1), (3, 2), None, None, (1, 1)]


def test_places_of_many_matches_equal_a_plain_count(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["a\nb", "x", "é", "\n", "😀", "ab"]) for _ in range(3000))
    rows = positions.statements(spark.createDataFrame([("p", "f", text)], FILES), {"ab": (r"a\n?b", "a")}).collect()
    want = []
    for m in re.finditer(r"a\n?b", text):
        before = text[: m.start()]
        want.append((before.count("\n") + 1, len(before) - before.rfind("\n"), m[0]))
    assert [(r["line"], r["col"], r["found"]) for r in rows] == want


def test_manifest_members_have_their_places(spark):
    content = '{\n  "name": "x",\n  "author": {"name": "JPD"},\n  "dependencies": {\n    "ui": "http://packages.storeartifact.com/npm/u",\n    "ok": "^1.0.0"\n  },\n  "devDependencies": {"t":   "https://y.example/t"}\n}'
    files = [("p", "package.json", content), ("p", "a/package.json", "{broken"), ("p", "package.json.txt", content), ("p", "b/package.json", None)]
    rows = manifests.manifest_findings(spark.createDataFrame(files, FILES)).collect()
    assert sorted((r["line"], r["col"], r["severity"], r["category"]) for r in rows) == [(1, 1, "high", "rdd_attack"), (3, 14, "critical", "rdd_attack"), (5, 5, "critical", "rdd_attack")]
