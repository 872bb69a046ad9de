"""Writers, ciphers near execution, campaign conditions and gates, by literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from auspex.operators import correlate, gates, report, runs, scoring
from auspex.sources import shared

FINDING = "package_name string, file_path string, line long, col long, code_point long, category string, severity string, description string, confidence double"
FILES = "package_name string, file_path string, content string"


def finding(category, severity="high", package="p", path="a.js", description="d"):
    return (package, path, 3, 7, 0, category, severity, description, None)


def test_written_reports_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([finding("blockchain_c2", "critical"), finding("unknown", "low", description='é "quoted"'), finding("unknown", "info")], FINDING)
    report.write_sarif(rows, str(tmp_path / "sarif"))
    results = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "sarif")).collect()]
    assert sorted((r["ruleId"], r["level"], r["message"]["text"]) for r in results) == [("blockchain_c2", "error", "d"), ("unknown", "none", "d"), ("unknown", "note", 'é "quoted"')]
    assert results[0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.js"}, "region": {"startLine": 3, "startColumn": 7}}
    report.write_json_lines(rows, str(tmp_path / "json"))
    assert sorted(map(str, spark.read.schema(FINDING).json(str(tmp_path / "json")).collect())) == sorted(map(str, rows.collect()))
    assert sorted(tuple(r) for r in report.sarif_rules(rows).collect()) == [("blockchain_c2", "error", "d", 1), ("unknown", "note", "d", 2)]


CIPHER = ["var s = new Array(256)", "o = a ^ b", "k & 0xFF", "t = s[i];s[i] = s[j]; s[j] = t", "String.fromCharCode(c)"]


@pytest.mark.parametrize(
    "lines,path,want",
    [
        (CIPHER, "src/a.js", (6, 0.85)),
        (CIPHER[:3], "src/a.js", (4, 0.5)),
        (CIPHER[1:], "src/a.js", (5, 0.7)),
        (CIPHER[:2], "src/a.js", None),
        (["s = [1]; m < 256; x % 2560; tmp = a; y & 254"] + CIPHER[1:2], "src/a.js", None),
        (CIPHER, "test/a.js", None),
        (CIPHER, "dist/a.js", None),
    ],
)
def test_stream_ciphers(spark, lines, path, want):
    content = "\n".join([*lines, "eval(x)", "eval(y)"])
    found = runs.stream_ciphers(spark.createDataFrame([("p", path, content), ("q", path, "\n".join(lines)), ("r", path, None)], FILES))
    assert [(r["package_name"], r["line"], r["confidence"]) for r in found.collect()] == ([("p", *want)] if want else [])
    assert [(r["category"], r["severity"]) for r in runs.cipher_findings(found).collect()] == ([("rc4_pattern", "info")] if want else [])


def test_campaign_classes(spark):
    of = {
        "a": ["stegano_payload", "blockchain_c2", "rdd_attack"], "b": ["rdd_attack", "forcememo_python"], "c": ["forcememo_python", "stegano_payload"], "d": ["time_delay_sandbox_evasion", "decoder_function"],
        "e": ["time_delay_sandbox_evasion", "decoder_function"], "f": ["time_delay_sandbox_evasion"], "g": ["stego_pattern"], "h": ["invisible_character"],
    }
    rows = spark.createDataFrame([finding(c, package=p) for p, cs in of.items() for c in cs], FINDING)
    domains = spark.createDataFrame([("d", "x.claude.example"), ("d", "mcp.example"), ("e", "m.cp.example"), ("g", "mcp.example")], "package_name string, domain string")
    found = {r["package_name"]: r["campaign"] for r in correlate.campaign_class(rows, domains).collect()}
    assert found == {"a": "stego_with_chain", "b": "remote_dependency", "c": "python_loader", "d": "sandbox_delay", "e": "stego", "f": "unknown", "g": "unknown", "h": "stego"}


def test_findings_without_gates_pass(spark):
    rows = spark.createDataFrame([finding("homoglyph", path="a.md"), finding("homoglyph", path="gone.md"), finding("homoglyph")], FINDING)
    files = gates.with_gates(spark.createDataFrame([("p", "a.md", "x"), ("p", "a.js", None)], FILES))
    assert sorted(r["file_path"] for r in gates.gated(rows, files).collect()) == ["a.js", "gone.md"]


def test_stages_and_rates(spark):
    row = spark.createDataFrame([(5.0, 0.2, 0.9), (5.0, 0.3, 0.75), (5.0, 0.3, 0.5), (8.0, 0.3, 0.5)], "s double, t double, a double")
    assert [r[0] for r in row.select(scoring.llm_stage(F.col("s"), F.col("t"), F.col("a"))).collect()] == ["triage", "analysis", "deep_dive", "analysis"]
    rates = spark.createDataFrame([(30, 60, 2.0), (0, 60, 2.0), (3, 1, 0.0)], "d int, r int, m double").select(report.scan_rate(F.col("d"), F.col("r"), F.col("m")).alias("x"))
    assert [tuple(r["x"]) for r in rates.collect()] == [(15.0, 240.0), (0.0, None), (None, None)]


def test_changes_in_nested_folders_are_seen(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(f"{path}/lang=en")
    before = shared.input_state(spark, path)
    spark.range(2).write.parquet(f"{path}/lang=fr/part=1")
    assert shared.input_state(spark, path) != before and len(before) > 0
