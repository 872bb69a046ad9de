"""Literal rows of gates, variants, borne-out findings and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auspex.operators import enrich, gates, summaries, variants


def test_gates(spark):
    rows = [
        ("p", "src/app.js", "let a = 1;\n", ""),
        ("p", "a/dist/app.js", "let a = 1;\n", "bundled minified likely_built"),
        ("p", "src/A.MIN.js", "x", "bundled likely_built"),
        ("p", "src/app.cjs", "x", "bundled likely_built"),
        ("p", "src/x-prod.js", "x", "likely_built"),
        ("p", "README.md", "/* webpack", "bundled documentation"),
        ("p", "src/vite.config.js", "x", "minified"),
        ("p", "src/200.js", "x" * 200, ""),
        ("p", "src/201.js", "x" * 201, "minified"),
        ("p", "src/even.js", ("y" * 199 + "\n") * 2, ""),
        ("p", "src/large.js", ("z" * 99 + "\n") * 5001, "large likely_built"),
        ("p", "src/sign.js", "webpackJsonp", "minified"),
        ("p", "src/null.js", None, ""),
        ("p", "tests/a.js", "x", "test"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "package_name string, file_path string, content string")
    for got in gates.with_gates(df).collect():
        want = next(r[3].split() for r in rows if r[1] == got["file_path"])
        flags = {k.removeprefix("is_") for k, v in got.asDict().items() if v is True}
        assert flags == set(want), got


def test_gated_findings(spark):
    files = spark.createDataFrame([("p", "src/a.js", "x"), ("p", "dist/../x/dist/a.js", "x"), ("p", "a.md", "x")], "package_name string, file_path string, content string")
    found = [(f, c, s) for f in ("src/a.js", "dist/../x/dist/a.js", "a.md") for c, s in (("invisible_character", "high"), ("invisible_character", "critical"), ("homoglyph", "high"), ("stego_pattern", "high"), ("header_c2", "critical"))]
    df = spark.createDataFrame([("p", *r) for r in found], "package_name string, file_path string, category string, severity string")
    kept = {(r["file_path"], r["category"], r["severity"]) for r in gates.gated(df, gates.with_gates(files)).collect()}
    gone = set(found) - kept
    assert gone == {
        ("dist/../x/dist/a.js", "invisible_character", "high"), ("dist/../x/dist/a.js", "stego_pattern", "high"),
        ("a.md", "invisible_character", "high"), ("a.md", "invisible_character", "critical"), ("a.md", "homoglyph", "high"), ("a.md", "stego_pattern", "high"),
    }
    assert gates.at_least(df, "critical").count() == 6


def test_variants(spark):
    text = "const decoder = atob(value);\nBuffer.from('base64')\na️b​\n4\n5\n6"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string")
    got = {r["variant"]: r["content"] for r in variants.variants(df, "k", "text", rate=1.0).collect()}
    assert set(got) == set(variants.VARIANTS)
    marks = "​‌‍︀\U000e0100"
    assert got["invisible"] == "".join(c + (marks[i // 10 % 5] if i % 10 == 0 else "") for i, c in enumerate(text))
    assert got["look_alikes"].startswith("сοnst dесоdеr".replace("ο", "о"))
    assert got["bidi"] == "‪" + text + "‬"
    assert got["selectors"] == "".join(chr(0xFE00 + b) for b in text.encode())
    lines = text.split("\n")
    assert got["noise"] == "".join(t + "\n" + ({0: "// TODO: fix this later\n", 5: "/* deprecated */\n"}.get(i, "")) for i, t in enumerate(lines))
    assert got["names"] == text.replace("value", "_0x3e4f")
    assert got["decoder_names"] == text.replace("decoder", "d3c0d3r")
    assert got["encodings"] == text.replace("atob(", "hexDecode(").replace("Buffer.from('base64')", "Buffer.hexFrom('hex')")
    assert got["turned"] == text.replace("️", "︎").replace("​", "‌")
    some = [{r["variant"]: r["content"] for r in variants.variants(df, "k", "text", seed=3, rate=0.3).collect()} for _ in range(2)]
    assert some[0] == some[1] and len(text) <= len(some[0]["invisible"]) < len(got["invisible"])


def test_evasion_levels(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 0.75, 0.5, 0.3, 0.1, 0.09)], "evasion_rate double")
    got = [(r["severity"], r["risk_level"]) for r in variants.evasion_levels(df).orderBy(F.desc("evasion_rate")).collect()]
    assert got == [("critical", "critical"), ("high", "critical"), ("medium", "critical"), ("low", "high"), ("low", "medium"), ("low", "low")]


def test_enrichment(spark):
    found = spark.createDataFrame([("a", "x", 0.5), ("b", "x", None), ("b", "x", 0.92), ("c", "x", 0.88), ("d", "exfil_schema", 0.5), ("e", "apc_injection", 0.5), ("f", "x", 0.5)], "file_path string, category string, confidence double")
    context = spark.createDataFrame([("filesystem", "a", "low", None), ("filesystem", "lib.node", "low", None), ("binary", "b", "low", None), ("js", "b", "low", None), ("binary", "c", "low", None), ("js", "f", "low", None), ("chrome", "z", "high", "permissions: tabs")], "kind string, file_path string, severity string, context string")
    got = {(r[0], r[1], None if r[2] is None else round(r[2], 6), r[3]) for r in enrich.enriched(found, context).collect()}
    both = "binary payload correlation, JS+binary multi-layer detection"
    assert got == {
        ("a", "x", 0.6, "filesystem artifact found"), ("b", "x", 0.75, both), ("b", "x", 0.92, both), ("c", "x", 0.95, "binary payload correlation"),
        ("d", "exfil_schema", 0.6, "Chrome extension correlation"), ("e", "apc_injection", 0.6, "filesystem artifact found"), ("f", "x", 0.5, ""),
    }
    assert {r["correlations"] for r in enrich.enriched(found, context.limit(0)).collect()} == {""}


def test_summaries(spark):
    scans = spark.createDataFrame([("w1", True, False), ("w1", False, False), ("w2", True, True)], "wave string, flagged boolean, malicious boolean")
    rates = {r["wave"]: tuple(r)[1:] for r in summaries.wave_rates(scans).collect()}
    assert rates == {"w1": (2, 1, 0, 50.0, 0.0), "w2": (1, 1, 1, 100.0, 100.0), "total": (3, 2, 1, 66.666667, 33.333333)}
    assert "| total | 3 | 2 | 1 | 66.7% | 33.3% |" in {r["markdown"] for r in summaries.markdown_rows(summaries.wave_rates(scans)).collect()}
    scores = spark.createDataFrame([(x,) for x in (9, 10, 24, 25, 49, 50, 99, 100)], "s int").select("s", summaries.risk_level(F.col("s")), summaries.risk_action(F.col("s")))
    assert [tuple(r)[1:] for r in scores.orderBy("s").collect()] == [("MINIMAL", "IGNORE"), *[("LOW", "MONITOR")] * 2, *[("MEDIUM", "REVIEW")] * 2, *[("HIGH", "PRIORITY_REVIEW")] * 2, ("CRITICAL", "IMMEDIATE_INVESTIGATION")]
    rule = summaries.yara_rules(spark.createDataFrame([("r", "b", 'a"\\'), ("r", "a", "x"), ("r", "c", None)], "rule string, identifier string, value string")).first()
    assert rule["source"] == 'rule r\n{\n    strings:\n        $a = "x"\n        $b = "a\\"\\\\"\n    condition:\n        any of them\n}'
