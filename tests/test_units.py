"""Literal rows of detectors, scores, graphs, readers and streams; nothing here is read from the rules' own tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from auspex.operators import detect, graph, scoring, state
from auspex.sources import corpus
from auspex.streaming import progress

VS = "︁"


def found(spark, *files):
    """(category, severity, line, col) of files given as (path, content), by path."""
    df = spark.createDataFrame([("p", path, content) for path, content in files], "package_name string, file_path string, content string")
    out: dict[str, list] = {path: [] for path, _ in files}
    for r in detect.all_findings(df).collect():
        out[r["file_path"]].append((r["category"], r["severity"], r["line"], r["col"]))
    return {k: sorted(v) for k, v in out.items()}


def test_detectors_and_their_near_misses(spark):
    got = found(
        spark,
        ("src/rlo.js", "a\nconst x = \"‮ab\";"),
        ("src/plain.js", "const x = 'nothing here';\nlet y = 2;"),
        ("src/run16.js", "ok\n" + VS * 16),
        ("src/run15.js", "ok\n" + VS * 15),
        ("src/pipe4.js", "|" + VS * 4),
        ("src/pipe3.js", "|" + VS * 3),
        ("src/geo5.js", "if (l === 'ru-RU') {\n1\n2\n3\n4\nprocess.exit(0)"),
        ("src/geo6.js", "if (l === 'ru-RU') {\n1\n2\n3\n4\n5\nprocess.exit(0)"),
        ("test/geo5.js", "if (l === 'ru-RU') {\n1\n2\n3\n4\nprocess.exit(0)"),
        ("src/delay10.js", "if (process.env.CI) {}\n" + "\n" * 9 + "setTimeout(f, 900001)"),
        ("src/delay11.js", "if (process.env.CI) {}\n" + "\n" * 10 + "setTimeout(f, 900001)"),
        ("src/keys3.js", '{"walletCount": 1, "master_key": 2, "session_token": 3}'),
        ("src/keys2.js", '{"walletCount": 1, "master_key": 2}'),
        ("src/zw50.js", "​" * 50 + "‌" * 50),
        ("src/zw49.js", "​" * 49 + "‌" * 50),
        ("src/wallet.js", "x\ny\nconst w = 'BjVeAjPrSKFiingBn4vZvghsGj9KCE8AJVtbc9S8o8SC'"),
        ("src/homoglyph.js", "let pаyload = 1;"),
        ("src/cyrillic.js", "let привет = 1;"),
        ("src/blob.js", "const b = '" + "ab12" * 16 + "';\nconst d = createDecipheriv(b);\neval(d)"),
        ("src/blob63.js", "const b = '" + "ab12" * 15 + "abc';\nconst d = createDecipheriv(b);\neval(d)"),
    )
    has = lambda path, category, *rest: any(f[0] == category and f[1 : 1 + len(rest)] == rest for f in got[path])
    assert ("bidirectional_override", "critical", 2, 12) in got["src/rlo.js"]
    assert got["src/plain.js"] == []
    assert has("src/run16.js", "stegano_payload", "critical", 2) and not has("src/run15.js", "stegano_payload")
    assert has("src/pipe4.js", "pipe_delimiter_stego", "high", 1) and not has("src/pipe3.js", "pipe_delimiter_stego")
    assert has("src/geo5.js", "locale_geofencing", "critical", 1) and not has("src/geo6.js", "locale_geofencing") and not has("test/geo5.js", "locale_geofencing")
    assert has("src/delay10.js", "time_delay_sandbox_evasion", "critical", 11) and not has("src/delay11.js", "time_delay_sandbox_evasion", "critical") and has("src/delay11.js", "time_delay_sandbox_evasion", "low", 12)
    assert has("src/keys3.js", "unknown", "high", 1) and got["src/keys2.js"] == []
    assert has("src/zw50.js", "stegano_payload", "critical", 1) and not has("src/zw49.js", "stegano_payload")
    assert has("src/wallet.js", "blockchain_c2", "critical", 3)
    assert has("src/homoglyph.js", "homoglyph", "critical", 1, 6) and not has("src/cyrillic.js", "homoglyph")
    assert has("src/blob.js", "encrypted_payload", "high", 1) and not has("src/blob63.js", "encrypted_payload")


def test_an_inert_line_changes_no_other_finding(spark):
    lines = ["const x = \"‮ab\";", "if (process.env.CI) {}", "setTimeout(f, 900001)", "log(LoadLibararyFail)"]
    both = found(spark, ("src/a.js", "\n".join(lines)), ("src/b.js", "\n".join([*lines, "let quiet = 1;"])))
    assert both["src/a.js"] == both["src/b.js"] != []


def scored(spark, rows):
    df = spark.createDataFrame([("p", "f", k + 1, 1, 0, c, s, d, x) for k, (c, s, d, x) in enumerate(rows)], "package_name string, file_path string, line long, col long, code_point long, category string, severity string, description string, confidence double")
    return scoring.independent_scores(df).first()["score"]


def test_scores_at_caps_and_floors(spark):
    many = lambda *categories: [(c, "critical", f"{c}{k}", 1.0) for c in categories for k in range(8)]
    assert scored(spark, [("homoglyph", "high", "x", 1.0)]) == 2.0
    assert scored(spark, [("homoglyph", "high", "x", None)]) == 1.0
    assert scored(spark, many("homoglyph", "header_c2")) == 3.5
    assert scored(spark, many("invisible_character")) == 5.0
    assert scored(spark, many("invisible_character", "homoglyph")) == 7.0
    assert scored(spark, many("invisible_character", "homoglyph", "header_c2")) == 8.5
    assert scored(spark, many("invisible_character", "homoglyph", "header_c2", "unicode_tag")) == 10.0
    assert scored(spark, [("blockchain_c2", "critical", "Known C2 wallet", 1.0)]) == 9.0
    assert scored(spark, [("stegano_payload", "critical", "payload with decoder", 1.0)]) == 8.5
    assert scored(spark, [("stegano_payload", "critical", "decoder in a locale", 1.0)]) == 3.0


def test_multipliers_at_their_bounds(spark):
    got = spark.createDataFrame([(0.1,), (0.2,), (0.5,), (0.75,), (None,)], "c double").select(F.round(scoring.llm_multiplier(F.col("c")), 6).alias("m")).collect()
    assert [r["m"] for r in got] == [0.25, 0.3, 0.5, 0.7, 1.0]
    cases = [(1_000_001, 1096, True, 0.3), (1_000_000, 1096, True, 0.5), (100_001, 366, False, 0.7), (10_001, 91, True, 0.85), (1000, 5000, True, 1.0)]
    got = spark.createDataFrame(cases, "d long, a long, v boolean, want double").select(scoring.reputation_multiplier(F.col("d"), F.col("a"), F.col("v")).alias("m"), "want").collect()
    assert all(r["m"] == r["want"] for r in got)


def test_imports_of_parent_folders(spark):
    files = spark.createDataFrame([("p", "src/lib/a.js", "import { x } from '../b'\nimport y from './../../c.ts'"), ("p", "src/b.js", ""), ("p", "c.ts", "const z = require('./src/lib/missing')")], "package_name string, file_path string, content string")
    edges = graph.resolved(graph.import_edges(files), files)
    assert {(r["from_file"], r["to_file"]) for r in edges.collect()} == {("src/lib/a.js", "src/b.js"), ("src/lib/a.js", "c.ts")}
    target = spark.createDataFrame([("p", "c.ts")], "package_name string, to_file string")
    assert [r["from_file"] for r in graph.importers(edges, target).collect()] == ["src/lib/a.js"]


def test_long_ways_and_cycles_are_reached(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(70)] + [("n70", "n0"), ("n0", "m"), ("m", "n2")], "a string, b string")
    reached = graph.distances(edges, spark.createDataFrame([("n0",)], "node string"))
    got = {r["node"]: r["distance"] for r in reached.collect()}
    assert got["n70"] == 70 and got["n2"] == 2 and len(got) == 72
    short = graph.shortest_paths(reached.where("distance <= 3"))
    assert {r["node"]: r["path"] for r in short.collect()}["n2"] == ["n0", "m", "n2"]


def test_look_alike_names(spark):
    got = {r["variant"] for r in state.name_variants(spark.createDataFrame([("left-pad",)], "name string")).collect()}
    assert got == {"left-pad-js", "left-padjs", "left-pad.js", "left-pad-official", "left-pad-lib", "@left-pad/core"}


def test_readers_of_folders_and_lists(spark, tmp_path):
    home = tmp_path / "pkg"
    (home / "node_modules" / "x").mkdir(parents=True)
    (home / "node_modules" / "x" / "e.js").write_text("left out")
    (home / "a.js").write_text("let a = 1\n")
    (home / "b.txt").write_text("no code")
    (home / "c.js").write_bytes(b"\xff\xfe bad")
    (home / "d.ts").write_text("x" * 3000)
    (tmp_path / "list.txt").write_text("# names\n left-pad \n\nreact@18\n")
    files = corpus.package_files(spark, str(tmp_path), most_bytes=2000).collect()
    assert [(r["package_name"], r["file_path"].rsplit("/", 1)[1], r["content"]) for r in files] == [("pkg", "a.js", "let a = 1\n")]
    assert sorted(r["package"] for r in corpus.package_list(spark, str(tmp_path / "list.txt")).collect()) == ["left-pad", "react@18"]
    specs = spark.createDataFrame([("react@18",), ("@s/n@1.2",), ("@s/n",), ("plain",)], "s string").select("s", corpus.package_spec(F.col("s")).alias("p")).collect()
    assert {r["s"]: (r["p"]["name"], r["p"]["version"]) for r in specs} == {"react@18": ("react", "18"), "@s/n@1.2": ("@s/n", "1.2"), "@s/n": ("@s/n", None), "plain": ("plain", None)}
    names = spark.createDataFrame([("left-pad-1.3.0.tgz",), ("odd.tgz",)], "s string").select("s", corpus.tarball_name(F.col("s")).alias("p")).collect()
    assert {r["s"]: (r["p"]["name"], r["p"]["version"]) for r in names} == {"left-pad-1.3.0.tgz": ("left-pad", "1.3.0"), "odd.tgz": ("odd", None)}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([(k, k % 3, "error" if k % 4 == 0 else "view", float(k)) for k in range(a, b)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600))
    source, sink, state_ = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows(0, 60).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    progress.run_available(spark, source, schema, progress.activity, sink, state_)
    first = spark.read.parquet(sink).agg(F.sum("n_events")).first()[0]
    rows(60, 120).write.mode("append").parquet(source)
    progress.run_available(spark, source, schema, progress.activity, sink, state_)
    got = {(r["window_start"], r["event_type"]): r["n_events"] for r in spark.read.parquet(sink).collect()}
    want = {(r["window_start"], r["event_type"]): r["n_events"] for r in progress.activity(rows(0, 120)).collect()}
    assert 0 < first < sum(got.values()) and all(want[k] == n for k, n in got.items()) and len(got) >= 0.8 * len(want)


def test_rules_on_whole_contents_and_their_near_misses(spark):
    zw = chr(0x200B)
    got = found(
        spark,
        ("src/loop.js", "decodeCommand(a)\nexecuteCommand(b)\nwait(300000)"),
        ("src/loop_sdk.js", "module.exports = 1\ndecodeCommand(a)\nexecuteCommand(b)\nwait(300000)"),
        ("src/rpc.js", "a\nb('rpc.ankr.com/solana')\nsetInterval(async () => 1)"),
        ("src/rpc_use.js", "useConnection\nb('rpc.ankr.com/solana')\nsetInterval(async () => 1)"),
        ("src/generic.js", "x\ngetSignaturesForAddress(w)\nsetInterval(f, 5)"),
        ("src/five.js", "setInterval(f, 300000)"),
        ("src/monitor2.js", "'X-Trace-ID'\nbtoa(password)"),
        ("src/monitor1.js", "'X-Trace-ID'\nbtoa(x)"),
        ("src/env.js", "fetch(u)\nBuffer.from(process.env.A)"),
        ("test/env.js", "fetch(u)\nBuffer.from(process.env.A)"),
        ("src/own.js", "fetch(u, {headers: {'X-Own': 1}})"),
        ("src/known.js", "fetch(u, {headers: {'X-User-Data': 1}})"),
        ("src/cpu.js", "if (os.cpus().length < 2) x()"),
        ("src/cpu_ci.js", "if (os.cpus().length < 2) x()\nif (isCI) y()"),
        ("src/ci.js", "if (process.env.CI) y()"),
        ("src/ci_plain.js", "const c = process.env.CI"),
        ("src/exit15.js", "process.env.CI\n" + "\n" * 14 + "process.exit(0)"),
        ("src/exit16.js", "process.env.CI\n" + "\n" * 15 + "process.exit(0)"),
        ("a/package.json", '{\n "name": "x' + zw * 5 + '"}'),
        ("b/package.json", '{\n "name": "x' + zw * 4 + '"}'),
        ("src/comment3.js", "//" + "A" * 47 + zw * 3),
        ("src/comment2.js", "//" + "A" * 48 + zw * 2),
    )
    of = lambda path, category: [f[1:3] for f in got[path] if f[0] == category]
    assert of("src/loop.js", "blockchain_c2") == [("critical", 1)] and of("src/loop_sdk.js", "blockchain_c2") == []
    assert of("src/rpc.js", "blockchain_c2") == [("high", 2), ("high", 2)] and of("src/rpc_use.js", "blockchain_c2") == [("high", 2)]
    assert of("src/generic.js", "blockchain_c2") == [("medium", 2)] and of("src/five.js", "blockchain_c2") == [("critical", 1)]
    assert of("src/monitor2.js", "header_c2") == [("medium", 1)] and of("src/monitor1.js", "header_c2") == []
    assert of("src/env.js", "header_c2") == [("critical", 2)] and of("test/env.js", "header_c2") == []
    assert of("src/own.js", "header_c2") == [("medium", 1)] and of("src/known.js", "header_c2") == []
    delay = "time_delay_sandbox_evasion"
    assert of("src/cpu.js", delay) == [("high", 1), ("medium", 1)] and ("high", 1) not in of("src/cpu_ci.js", delay)
    assert of("src/ci.js", delay) == [("medium", 1)] and of("src/ci_plain.js", delay) == []
    assert ("critical", 16) in of("src/exit15.js", delay) and of("src/exit16.js", delay) == []
    assert ("high", 3) in of("a/package.json", "stegano_payload") and of("b/package.json", "stegano_payload") == []
    assert ("high", 1) in of("src/comment3.js", "stegano_payload") and of("src/comment2.js", "stegano_payload") == []


def test_spread_by_rows_not_by_bytes(spark, tmp_path, monkeypatch):
    """One row group is one task's work however large the file is; even partitions stay where they are."""
    from auspex.sources import shared

    monkeypatch.setattr(shared, "SPREAD_BYTES", 64)  # the file has many times that a core
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/one")
    dealt = shared.spread(spark.read.parquet(f"{tmp_path}/one"))
    counts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 4000 and max(counts) * 8 <= 2 * 4000
    monkeypatch.setattr(shared, "SPREAD_BYTES", 16 << 20)
    even = spark.range(4000).repartition(16)
    assert shared.spread(even) is even


def test_content_flags_are_columns_and_lines_are_filtered(spark):
    """The rules' tests of a whole content are made once a file, not once a rule, and lines without a sign take no part."""
    from auspex.operators import contents

    text = "plain\n" * 50 + "// " + "QUJD" * 13 + "​" * 3 + "QUJD" * 13
    files = spark.createDataFrame([("p", "src/a.js", True, text)], "package_name string, file_path string, plain_source boolean, text string")
    found = contents.content_findings(files)
    assert [(r.line, r.description) for r in found.collect()] == [(51, "hidden characters in a base64 comment")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("async getSignaturesForAddress(") == 1
