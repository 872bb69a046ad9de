"""Rules on features of binaries and listings of hosts, by literal rows."""

from __future__ import annotations

import itertools

import pytest

from auspex.operators import binaries

FEATURES = "file_path string, sections array<struct<name:string,entropy:double>>, strings array<string>, imports array<string>, pdb_path string, cargo_paths array<string>"
GROUPS = {"high_entropy": {"sections": [(".t", 7.51), (".d", 7.5)]}, "xorshift_constants": {"strings": ["0x2C1B3C6D"]}, "shift_operations": {"imports": ["RoTate"]}, "position_dependent_key": {"strings": ["POSITION shift"]}, "multi_round_decode": {"strings": ["Round DECODE"]}}


def row(path, sections=None, strings=None, imports=None, pdb=None, crates=None):
    return (path, sections, strings, imports, pdb, crates)


def of_groups(names):
    parts = {"sections": [], "strings": [None], "imports": []}
    for n in names:
        for k, v in GROUPS[n].items():
            parts[k] = parts[k] + v
    return row(",".join(names), **parts)


def test_each_group_alone_and_in_combination(spark):
    names = [c for n in range(1, 6) for c in itertools.combinations(GROUPS, n)]
    found = {r["file_path"]: r for r in binaries.shift_obfuscation(spark.createDataFrame([of_groups(c) for c in names], FEATURES)).collect()}
    assert len(found) == 31
    for c in names:
        r = found[",".join(c)]
        assert (r["signals"], r["severity"], r["confidence"]) == (",".join(c), "high" if len(c) > 1 else "medium", {1: 0.6, 2: 0.85}.get(len(c), 0.95))
        assert (r["n_sections"], r["max_entropy"]) == ((1, 7.51) if "high_entropy" in c else (0, None))


def test_near_misses_of_the_generator(spark):
    rows = [row("a"), row("b", [(".t", 7.5), (".n", None), (".q", float("nan")), None], [None, "idx", "xor"], ["open", None]), row("c", [], ["round", "decode", "6c62272"], []), row("d", strings=["cascade", "index"], imports=["Shif t"])]
    assert binaries.shift_obfuscation(spark.createDataFrame(rows, FEATURES)).count() == 0


@pytest.mark.parametrize(
    "pdb,crates,strings,want",
    [
        ("N:\\work\\chrome_current\\a.pdb", None, None, ("N:\\work\\chrome_current", "high", 0.9)),
        ("C:\\Users\\Administrator\\.cargo", None, None, ("Administrator", "high", 0.9)),
        ("a/jucku/generate.pdb", None, None, ("generate.pdb,jucku", "info", 0.5)),
        ("C:\\Users\\Administrator", ["neon-1", "neon-2"], None, ("neon framework,Administrator", "info", 0.5)),
        ("C:\\Users\\Administrator", ["neon-1"], ["ext_sideloader", "myextension"], ("neon framework,ext_sideloader,myextension,Administrator", "high", 0.9)),
        (None, ["neon-1", None, "serde"], None, ("neon framework", "info", 0.5)),
        (None, None, ["davidioasd", "davidioasd", None], ("davidioasd", "info", 0.5)),
        ("DumpBrowserSecrets", None, ["DumpBrowserSecrets"], ("DumpBrowserSecrets,DumpBrowserSecrets", "high", 0.9)),
        ("administrator", ["serde"], ["x", ""], None),
        (None, None, None, None),
    ],
)
def test_build_metadata(spark, pdb, crates, strings, want):
    found = binaries.build_metadata(spark.createDataFrame([row("a", strings=strings, pdb=pdb, crates=crates)], FEATURES)).collect()
    assert [(r["indicators"], r["severity"], r["confidence"]) for r in found] == ([want] if want else [])


def test_host_artifacts(spark):
    rows = [
        ("/t/SsWolTaQA", True), ("/t/SsWolTaQA/w.node", False), ("/t/SsWolTaQA/w.node", False), ("/u/my_node_x64/", True), ("/u/my_node_x64/sub/data", False), ("/u/_node_x86", False), ("/u/_node_x86_node_x64", None),
        ("/v/DumpBrowserSecrets_node_x86", True), ("/v/DumpBrowserSecrets_node_x86/m", True), ("m", None), ("/v/m.txt", False), (None, True), ("/work/chrome_current", True), ("", True),
    ]
    found = sorted(tuple(r) for r in binaries.host_artifacts(spark.createDataFrame(rows, "path string, is_dir boolean")).collect())
    assert found == sorted([
        ("/t/SsWolTaQA", "folder", "SsWolTaQA", "high"), ("/t/SsWolTaQA/w.node", "file", "w.node", "high"), ("/u/my_node_x64", "folder", "_node_x64", "medium"), ("/u/my_node_x64/sub/data", "file", "data", "high"),
        ("/v/DumpBrowserSecrets_node_x86", "folder", "DumpBrowserSecrets", "high"), ("/v/DumpBrowserSecrets_node_x86", "folder", "_node_x86", "high"), ("/v/DumpBrowserSecrets_node_x86/m", "file", "m", "high"), ("m", "file", "m", "high"),
    ])
