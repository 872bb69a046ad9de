"""Literal rows and brute force for payloads, indicators, alike code, campaigns and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from auspex.operators import indicators, payload, selection, similar

MASK = (1 << 64) - 1


def brute_signature(text):
    chars = "".join(" " if c.isspace() else c for c in text or "")
    hashes = []
    for k in range(len(chars) - 2):
        h = 14695981039346656037
        for b in chars[k : k + 3].encode():
            h = ((h ^ b) * 1099511628211) & MASK
        hashes.append(h)
    return [min((h + i * 0x9E3779B97F4A7C15) & MASK for h in hashes) if hashes else MASK for i in range(128)]


def brute_clusters(packages):
    signed = {n: brute_signature(t) for n, t in packages}
    taken, out = set(), set()
    for a in sorted(signed):
        if a in taken:
            continue
        like = [b for b in sorted(signed) if b > a and b not in taken and sum(x == y for x, y in zip(signed[a], signed[b])) / 128 >= 0.7]
        if like:
            taken |= {a, *like}
            out |= {(p, a) for p in (a, *like)}
    return out


def test_code_clusters_equal_brute_force(spark):
    base = "function add(a, b) { return a + b; } // the sum of two numbers, whatever they are\n"
    far = "class Node:\n    def walk(self):\n        yield from (child.walk() for child in self.children)\n"
    packages = [("p01", base * 2), ("p02", base * 2 + "let x = 1;"), ("p03", base + "let xyz = 12345; run(xyz);"), ("p04", far), ("p05", far), ("p06", far + "é ü\tend"), ("p07", ""), ("p08", None), ("p09", "ab"), ("p10", "nothing like any of these: 9876543210"), ("p11", base + far)]
    packages += [(f"q{k:02}", base[: 20 + 3 * k] + far[: 90 - 2 * k]) for k in range(20)]
    df = spark.createDataFrame(packages, "package_name string, content string")
    got = {(r["package_name"], r["cluster"]) for r in similar.code_clusters(df).collect()}
    assert got == brute_clusters(packages) and len(got) > 8
    assert similar.code_clusters(df.limit(0)).count() == 0
    signed = {r["package_name"]: [x & MASK for x in r["signature"]] for r in similar.signatures(df).collect()}
    assert all(signed[n] == brute_signature(t) for n, t in packages)


def test_code_clusters_in_blocks_without_pairs(spark, monkeypatch):
    """Several blocks give brute force's clusters, a package the first of its leaders by name; no table holds the pairs of a group of alike packages."""
    import random

    draw = random.Random(7)
    bases = ["".join(draw.choice("abcdefgh {};=") for _ in range(160)) for _ in range(6)]
    packages = [(f"n{k:03}", draw.choice(bases)[: draw.randrange(60, 160)] + "".join(draw.choice("xyz") for _ in range(draw.randrange(12)))) for k in range(220)]
    packages += [(f"z{k:03}", "a group of packages that are all alike but for their last number, and as long as this one is: " + str(k)) for k in range(150)]
    monkeypatch.setattr(similar, "BLOCK", 64)
    sizes = []
    kept = similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, name: (made := kept(df, name), sizes.append(made.count()))[0])
    df = spark.createDataFrame(packages, "package_name string, content string").repartition(5)
    got = {(r["package_name"], r["cluster"]) for r in similar.code_clusters(df).collect()}
    assert got == brute_clusters(packages) and len(got) > 200
    assert max(sizes) <= len(packages)


def test_signatures_are_compared_by_most_different_positions_first(spark):
    """Pairs equal plain comparison with any order of positions; characters of all lengths in UTF-8 give brute force's signatures."""
    import numpy as np

    draw = np.random.default_rng(5)
    longs = draw.integers(0, 1 << 60, (60, 128))
    longs[:, 64:] = 7  # the same in all: they tell nothing apart
    longs[30:] = np.where(draw.random((30, 128)) < 0.35, draw.integers(0, 1 << 60, (30, 128)), longs[:30])
    signed = similar.Signatures(longs)
    assert similar.Signatures(longs[:30]).order[:64].max() < 64
    here, there = signed.alike(similar.Signatures(longs, signed.order), 0.7)
    plain = [(a, b) for a in range(60) for b in range(60) if (longs[a] == longs[b]).sum() >= 90]
    assert list(zip(here.tolist(), there.tolist())) == plain and len(plain) > 60
    for text in ("aé漢😀\x85b\u3000c", "😀" * 9, "\x00\x7f\x80\u07ff\u0800\uffff\U00010000\U0010ffff", "plain text\x1c\twith\xa0spaces"):
        assert [int(x) for x in similar.minhash(text)] == brute_signature(text)


def test_campaigns(spark):
    shared = spark.createDataFrame([("a", "domain", "d1"), ("b", "domain", "d1"), ("b", "wallet", "w"), ("c", "wallet", "w"), ("e", "author", "x")], "package_name string, kind string, value string")
    code = spark.createDataFrame([("a", "a"), ("b", "a"), ("m", "m"), ("n", "m"), ("o", "m"), ("r", "r"), ("s", "r")], "package_name string, cluster string")
    rows = {r["campaign"]: tuple(r)[1:] for r in similar.campaigns(shared, code).collect()}
    assert rows == {"a": (3, 1, 0.95), "code:m": (3, 1, 0.45)}
    pairs = similar.related(shared, shared.where("package_name = 'b'").select("package_name")).collect()
    assert sorted(tuple(r) for r in pairs) == [("b", "a", 1), ("b", "c", 1)]


def test_payloads(spark):
    vs = lambda data: "".join(chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in data)
    rows = [(1, "x" + vs(b"hi!")), (2, vs(b"hi!!")), (3, vs(b"plain text, long enough")), (4, vs(bytes(range(256)))), (5, vs(b"\xff" * 20)), (6, "nothing"), (7, None), (8, vs(bytes(range(64, 128))))]
    got = {r["id"]: (r["n_bytes"], r["payload_class"], r["decoded"]) for r in payload.payloads(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {2: (4, "too_small", "hi!!"), 3: (23, "plaintext", "plain text, long enough"), 4: (256, "encrypted", None), 5: (20, "suspicious", None), 8: (64, "suspicious", bytes(range(64, 128)).decode())}
    back = spark.range(1).select(payload.hidden_bytes(payload.selectors(F.unhex(F.lit("00 0F 10 FF".replace(" ", ""))))).alias("b")).first()["b"]
    assert bytes(back) == b"\x00\x0f\x10\xff"


def test_indicators(spark):
    strings = [("a", "QueueUserAPC"), ("a", "VirtualAllocEx"), ("a", "xWriteProcessMemory"), ("b", "LoadResource"), ("b", "LockResource"), ("c", "LoadResource"), ("c", "LockResource"), ("c", "FindResourceW"), ("d", "memexec"), ("e", "memexec::x generate.dll"), ("f", "LoadLibararyFail"), ("g", None)]
    df = spark.createDataFrame(strings, "file_path string, value string")
    assert {r["file_path"]: r["severity"] for r in indicators.injection(df).collect()} == {"a": "high", "c": "medium"}
    assert {r["file_path"]: (r["severity"], r["confidence"]) for r in indicators.memory_loaders(df).collect()} == {"d": ("medium", 0.7), "e": ("high", 0.7), "f": ("high", 0.98)}
    memo = lambda m, w: spark.range(1).select(indicators.memo_severity(F.lit(m).cast("string"), F.lit(w)).alias("s")).first()["s"]
    known = "BjVeAjPrSKFiingBn4vZvghsGj9KCE8AJVtbc9S8o8SC"
    assert [memo("{", "w"), memo('{"link": "a"}', known), memo('{"c2server": "a"}', "w"), memo('{"link": "a"}', "w"), memo('{"checkIp": "a"}', known)] == ["info", "high", "medium", "info", None]
    sizes = spark.createDataFrame([("x/Secure Preferences", n) for n in (1023, 1024, 100_000, 100_001)] + [("x/Preferences", 1)], "file_path string, bytes long")
    assert sorted(r["bytes"] for r in indicators.odd_preferences(sizes).collect()) == [1023, 100_001]


def test_selection(spark):
    files = [("p", "p/index.js", "i" * 10_001), ("p", "p/a.js", "a" * 5_001), ("p", "p/.b.js", "b"), ("p", "p/node_modules/c.js", "c"), ("p", "p/d.ts", "d"), ("p", "p/package.json", "{}")]
    got = {r["file_path"]: len(r["content"]) for r in selection.review_files(spark.createDataFrame(files, "package_name string, file_path string, content string")).collect()}
    assert got == {"p/index.js": 10_000, "p/a.js": 5_000, "p/package.json": 2}
    counts = spark.createDataFrame([(1, 8, 0, 0, 10), (2, 6, 0, 0, 10), (3, 2, 6, 0, 10), (4, 0, 0, 9, 10), (5, 0, 1, 1, 10), (6, 0, 0, 0, 0)], "k int, n_malicious long, n_suspicious long, n_false long, n_total long")
    kinds = {r["k"]: (r["classification"], r["tier"], r["recommendation"]) for r in selection.overall(counts).collect()}
    assert kinds[1] == ("MALICIOUS", "CONFIRMED", "REPORT_IMMEDIATELY") and kinds[2][1] == "HIGH_CONFIDENCE" and kinds[3][0] == "SUSPICIOUS"
    assert kinds[4][0] == "FALSE_POSITIVE" and kinds[5] == ("NEEDS_REVIEW", "UNCLASSIFIED", "REVIEW") and kinds[6][0] == "CLEAN"


def test_related_packages_of_a_frequent_value_in_parts(spark, monkeypatch):
    """A value of all packages is met in parts, dealt by number, and the pairs are those of a plain loop."""
    monkeypatch.setattr(similar, "PART", 16)
    monkeypatch.setattr(similar, "PAIRS", 500)
    rows = [(f"p{k:03}", "domain", "one") for k in range(300)] + [(f"p{k:03}", "author", f"a{k % 7}") for k in range(0, 300, 5)]
    shared = spark.createDataFrame(rows, "package_name string, kind string, value string")
    wanted = shared.where("package_name LIKE '%0'").select("package_name")
    found = similar.related(shared, wanted)
    has: dict = {}
    for p, kind, value in rows:
        has.setdefault(p, set()).add((kind, value))
    want = {(a, b, len(has[a] & has[b])) for a in has if a.endswith("0") for b in has if a != b}
    assert {tuple(r) for r in found.collect()} == want
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
