"""Modules: every form by literal rows with near misses, importers, and flows against a plain breadth-first search."""

from __future__ import annotations

import random

import pytest

from auspex.operators import modules
from auspex.plans.crossfile import PLANTS

FILES = "package_name string, file_path string, content string"


def symbols(spark, content, path="src/a.js"):
    rows = modules.symbols(spark.createDataFrame([("p", path, content)], FILES)).collect()
    return sorted(((r["form"], r["local"], r["original"], r["module"], r["line"]) for r in rows), key=str)


def test_every_form_and_its_line(spark):
    content = "\r\n".join(p for p, _ in PLANTS).replace("{n}", "1")
    line, want = 1, []
    for plant, rows in PLANTS:
        want += [tuple(x and x.replace("{n}", "1") for x in r) + (line,) for r in rows]
        line += plant.count("\n") + 1
    assert symbols(spark, content) == sorted(want, key=str)


@pytest.mark.parametrize("content", [None, "", "important { a } from 'b'", "import from './m'", "export nothing", "require('./m')", "exports.p - 2", "module.exports"])
def test_near_misses(spark, content):
    assert symbols(spark, content) == []


def test_renamed_defaults_and_stars_are_met_inside(spark):
    files = [
        ("p", "lib/d.js", "export function decode(x) {}\nexport { decode as run };\nexport default decode"),
        ("p", "lib/all.js", "export * from './d'"),
        ("p", "a.js", "import { run as go } from './lib/d'"),
        ("p", "b.js", "import any from './lib/d.js'"),
        ("p", "c.js", "const { decode } = require('./lib/all')"),
        ("q", "a.js", "import { decode } from './lib/d'"),
        ("p", "e.js", "import { decode } from 'lib/d'"),
    ]
    frame = spark.createDataFrame(files, FILES)
    edges = modules.symbol_edges(modules.symbols(frame), frame)
    wanted = spark.createDataFrame([("p", "lib/d.js", "decode")], "package_name string, from_file string, symbol string")
    assert sorted((r["to_file"], r["local"]) for r in modules.importers(edges, wanted).collect()) == [("a.js", "go"), ("b.js", "any")]
    sources = spark.createDataFrame([("p", "lib/d.js", "decode", "stego_decoder", 1)], "package_name string, file_path string, symbol string, source_type string, line long")
    sinks = spark.createDataFrame([("p", f, s, "eval", 2) for f, s in (("a.js", "go"), ("b.js", "any"), ("c.js", "decode"), ("e.js", "decode"), ("lib/d.js", "decode"), ("a.js", "decode"))], "package_name string, file_path string, symbol string, kind string, line long")
    found = modules.flows(edges, sources, sinks).collect()
    assert sorted((r["sink_file"], r["hops"], "/".join(r["path"]), r["confidence"], r["severity"]) for r in found) == [
        ("a.js", 1, "lib/d.js/a.js", 1.0, "critical"), ("b.js", 1, "lib/d.js/b.js", 1.0, "critical"), ("c.js", 2, "lib/d.js/lib/all.js/c.js", 1.0, "critical"), ("lib/d.js", 0, "lib/d.js", 0.8, "high"),
    ]


def plain_flows(edges, sources, sinks):
    out = []
    for file, symbol in sources:
        best, front = {(file, symbol): (0, [file])}, {(file, symbol): [file]}
        while front:
            after = {}
            for (f, s), path in front.items():
                for a, there, b, here in edges:
                    if a == f and there in (s, None):
                        state, longer = (b, here if there else s), [*path, b]
                        if state not in best and (state not in after or longer < after[state]):
                            after[state] = longer
            best |= {k: (len(p) - 1, p) for k, p in after.items()}
            front = after
        out += [(file, symbol, f, s, *best[f, s]) for f, s in sinks if (f, s) in best]
    return sorted(out)


def test_flows_equal_a_plain_search_on_graphs_with_cycles(spark):
    rng = random.Random(8)
    file, name = lambda: f"f{rng.randrange(25)}.js", lambda: rng.choice("abc")
    edges = {(file(), name() if rng.random() < 0.9 else None, file(), name()) for _ in range(90)}
    sources, sinks = {(file(), name()) for _ in range(6)}, {(file(), name()) for _ in range(30)}
    found = modules.flows(
        spark.createDataFrame([("p", a, s, b, t, "x") for a, s, b, t in edges], "package_name string, from_file string, symbol string, to_file string, local string, form string"),
        spark.createDataFrame([("p", f, s, "http_header", 1) for f, s in sources], "package_name string, file_path string, symbol string, source_type string, line long"),
        spark.createDataFrame([("p", f, s, "network_request", 1) for f, s in sinks], "package_name string, file_path string, symbol string, kind string, line long"),
    ).collect()
    assert sorted((r["source_file"], r["source_symbol"], r["sink_file"], r["sink_symbol"], r["hops"], r["path"]) for r in found) == plain_flows(edges, sources, sinks)
    assert {(r["hops"] > 0, r["hops"] > 1, r["confidence"], r["severity"]) for r in found} >= {(True, False, 0.7, "critical"), (True, True, 0.8, "critical")}


def test_a_payload_split_over_files(spark):
    decoder = "export const decoder = (s) => {\n  return [...s].map(c => c.codePointAt(0) - 0xFE00)\n}\nexport const other = 1"
    files = [("p", "decoder.js", decoder), ("p", "payload.js", "import { decoder as d, other } from './decoder'\n\neval(d)\neval(other)\nreeval(d)"), ("p", "one.js", decoder + "\nnew Function(decoder)")]
    found = modules.split_payloads(spark.createDataFrame(files, FILES)).collect()
    assert [(r["source_file"], r["source_symbol"], r["source_type"], r["source_line"], r["sink_file"], r["sink_symbol"], r["sink_kind"], r["sink_line"], r["severity"]) for r in found] == [("decoder.js", "decoder", "stego_decoder", 1, "payload.js", "d", "eval", 3, "critical")]
    inside = modules.flows(modules.symbol_edges(modules.symbols(spark.createDataFrame(files, FILES)), spark.createDataFrame(files, FILES)), modules.defined_sources(spark.createDataFrame(files, FILES)), modules.call_sinks(spark.createDataFrame(files, FILES))).where("hops = 0").collect()
    assert [(r["sink_file"], r["sink_kind"], r["severity"]) for r in inside] == [("one.js", "function_constructor", "high")]


def test_sources_and_sinks_of_each_kind(spark):
    code = "let a = createDecipheriv('x')\nvar b = r.headers.get('y')\nconst c = '" + "Ab1+" * 16 + "'\nfunction d() {}\nexecSync(a)\nvm.runInNewContext(b)\nspawn( c )\nfetch(await d)\nunfetch(d)"
    files = spark.createDataFrame([("p", "f.js", code)], FILES)
    assert sorted((r["symbol"], r["source_type"], r["line"]) for r in modules.defined_sources(files).collect()) == [("a", "crypto_output", 1), ("b", "http_header", 2), ("c", "encrypted_payload", 3)]
    assert sorted((r["symbol"], r["kind"], r["line"]) for r in modules.call_sinks(files).collect()) == [("a", "child_process", 5), ("b", "vm_run", 6), ("c", "process_spawn", 7), ("d", "network_request", 8)]
