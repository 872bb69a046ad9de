"""Packages in archives against the same trees unpacked to disk."""

from __future__ import annotations

import gzip
import io
import json
import os
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auspex.sources import archives
from auspex.sources.walks import WALKS

MIB = 1 << 20
LONG = "package/" + "deep/" * 60 + "x.js"


def packed(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as tar:
        for name, data in members:
            if isinstance(data, tarfile.TarInfo):
                tar.addfile(data)
                continue
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def link(name, target):
    info = tarfile.TarInfo(name)
    info.type, info.linkname = tarfile.SYMTYPE, target
    return name, info


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packages")
    (root / "in").mkdir()
    packed(root / "left-pad-1.3.0.tgz", [
        ("package/package.json", b"{}"), ("package/a.js", b"old"), ("package/a.js", "né".encode()), (LONG, b"long"), ("package/node_modules/q/b.js", b"no"), ("package/.git/c.js", b"no"), ("package/dist/d.min.js", b"built"),
        ("package/bin.js", b"\xff\xfe"), ("package/e.exe", b"no"), ("package/.js", b"no"), ("package/F.JS", b"no"), ("outside.js", b"no"), ("../up.js", b"no"), link("package/l.js", "a.js"), ("package/empty.ts", b""), ("package/build/dist.js", b"yes"),
    ])
    packed(root / "in/odd.tar", [("./package/package.json", json.dumps({"name": "@s/odd", "version": "9"}).encode()), ("./package/m.py", b"x")], "w")
    packed(root / "plain.tar", [("m.go", b"x"), ("package.json", b"[1]")], "w")
    packed(root / "nothing.tar", [("m.go", b"x"), ("package.json", b"{bad")], "w")
    packed(root / "nameless.tgz", [("m.go", b"x"), ("package.json", b'{"version": 3}')])
    packed(root / "bomb-1.tgz", [("package/a.js", b"x"), ("package/z.js", b"0" * (9 * MIB))])
    packed(root / "two-big-2.0.tgz", [("package/a.js", b"x"), ("package/big.js", b"1" * (3 * MIB))])
    (root / "empty-1.tgz").write_bytes(b"")
    whole = (root / "left-pad-1.3.0.tgz").read_bytes()
    (root / "cut-1.tgz").write_bytes(whole[: len(whole) // 2])
    (root / "sum-1.tgz").write_bytes(whole[:-8] + b"\0" * 8)
    (root / "no-1.tgz").write_bytes(b"no archive at all" * 99)
    (root / "fake-1.tar").write_bytes(gzip.compress(b"x"))
    (root / ".9-part-1.tgz").write_bytes(whole)
    (root / "readme.md").write_text("x")
    return root


OPTIONS = {"most_unpacked": 8 * MIB, "most_member": 2 * MIB, "partition_bytes": 1}


def base(rows):
    return [(r["archive"].rsplit("/", 1)[1], r["package_name"], r["version"], r["file_path"], r["content"], r["error"]) for r in rows]


@pytest.fixture(scope="module")
def rows(spark, folder):
    return base(archives.read_archives(spark, str(folder), **OPTIONS).collect())


def test_files_of_a_whole_archive(rows):
    found = {(p, c, e) for a, n, v, p, c, e in rows if a == "left-pad-1.3.0.tgz" and (n, v) == ("left-pad", "1.3.0")}
    assert found == {("package.json", "{}", None), ("a.js", "né", None), (LONG[8:], "long", None), ("dist/d.min.js", "built", None), ("empty.ts", "", None), ("build/dist.js", "yes", None)}


def test_rows_equal_the_unpacked_trees(rows, folder, tmp_path):
    for name in ("left-pad-1.3.0.tgz", "in/odd.tar", "plain.tar"):
        out = tmp_path / name.replace("/", "_")
        with tarfile.open(folder / name) as tar:
            tar.extractall(out, [m for m in tar.getmembers() if m.isreg() and ".." not in m.name], filter="data")
        top = out / "package" if (out / "package").exists() else out
        want = set()
        for at, _, files in os.walk(top):
            for f in files:
                path = os.path.relpath(os.path.join(at, f), top)
                data = (top / path).read_bytes()
                if WALKS["archive"].takes(path, len(data)):
                    try:
                        want.add((path, data.decode()))
                    except UnicodeDecodeError:
                        pass
        assert {(p, c) for a, _, _, p, c, _ in rows if a == os.path.basename(name)} == want


def test_names_come_from_the_file_then_the_manifest(rows):
    names = {a: (n, v) for a, n, v, *_ in rows}
    assert names["odd.tar"] == ("@s/odd", "9")
    assert names["plain.tar"] == ("unknown", "0.0.0")
    assert names["nothing.tar"] == ("nothing", "unknown")
    assert names["nameless.tgz"] == ("unknown", "0.0.0")
    assert names["two-big-2.0.tgz"] == ("two-big", "2.0")


def test_broken_and_oversized_archives_give_one_row(rows):
    broken = {a: e for a, _, _, p, c, e in rows if p is None}
    assert broken == {"bomb-1.tgz": "too large", "empty-1.tgz": "unreadable", "cut-1.tgz": "unreadable", "sum-1.tgz": "unreadable", "no-1.tgz": "unreadable", "fake-1.tar": "unreadable"}
    assert not [r for r in rows if r[0] in broken and r[3] is not None]
    assert {(p, c is None, e) for a, _, _, p, c, e in rows if a == "two-big-2.0.tgz"} == {("a.js", False, None), ("big.js", True, "too large")}
    assert len({r[0] for r in rows}) == 12


def test_headers_without_end_are_refused(folder):
    huge = io.BytesIO()
    with tarfile.open(fileobj=huge, mode="w", format=tarfile.PAX_FORMAT) as tar:
        info = tarfile.TarInfo("package/a.js")
        info.pax_headers = {"comment": "x" * (2 * archives.MOST_HEADER)}
        tar.addfile(info)
    got = list(archives.archive_rows("f/h-1.tar", lambda: io.BytesIO(huge.getvalue()), WALKS["archive"], lambda p: True))
    assert got == [("f/h-1.tar", "h", "1", None, None, "too large")]


def test_other_errors_fail_the_task(folder):
    def lost():
        raise OSError("connection reset")

    with pytest.raises(OSError, match="reset"):
        list(archives.archive_rows("f/h-1.tar", lost, WALKS["archive"], lambda p: True))


def test_partitions_hold_archives_by_their_bytes(folder):
    reader = archives.ArchiveReader({"path": str(folder), "partition_bytes": "1"})
    assert [len(p.paths) for p in reader.partitions()] == [1] * 12
    assert [len(p.paths) for p in archives.ArchiveReader({"path": str(folder)}).partitions()] == [12]


def test_filters_reach_the_source(spark, folder, rows):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        every = archives.read_archives(spark, str(folder), **OPTIONS)
        some = every.where(F.col("archive").endswith("left-pad-1.3.0.tgz") & F.col("file_path").startswith("d") & F.col("file_path").contains("min"))
        assert [r[3] for r in base(some.collect())] == ["dist/d.min.js"]
        assert every.where(F.col("file_path").isin("m.go", "m.py")).count() == 4
        assert every.where("file_path is null").count() == 6
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = archives.FilteringReader({"path": str(folder)})
    left = archives.EqualTo(("error",), "x")
    assert list(reader.pushFilters([archives.StringEndsWith(("archive",), "plain.tar"), archives.EqualTo(("file_path",), "m.go"), left])) == [left]
    assert [os.path.basename(p) for part in reader.partitions() for p in part.paths] == ["plain.tar"]


def test_written_archives_read_back(spark, tmp_path):
    rows = [("a-1.tgz", False, "package/x.js", "é"), ("a-1.tgz", False, "package/y.js", None), ("b-2.tar", True, "n" * 150 + ".js", "z" * 100_000)]
    given = spark.createDataFrame(rows, "archive string, plain boolean, member string, content string")
    assert archives.write_archives(given, str(tmp_path / "out")) == 2
    assert sorted(os.listdir(tmp_path / "out")) == ["a-1.tgz", "b-2.tar"]
    found = base(archives.read_archives(spark, f"file:{tmp_path}/out").collect())
    assert sorted(found) == [("a-1.tgz", "a", "1", "x.js", "é", None), ("a-1.tgz", "a", "1", "y.js", "", None), ("b-2.tar", "b", "2", "n" * 150 + ".js", "z" * 100_000, None)]
    assert archives.whole(archives.read_archives(spark, str(tmp_path / "out"))).columns == ["package_name", "file_path", "content"]
    assert archives.write_archives(given.limit(0), str(tmp_path / "none")) == 0
    assert archives.read_archives(spark, str(tmp_path / "none")).count() == 0


PATHS = ["a.js", "dist/a.js", "x/dist/a.js", "dist", "distance/a.ts", "a.min.js", "b/.js", "B.JS", "node_modules/a/b.js", "x/.git/a.json", "target.js", "a/build/b.md", "c.exe", "", "__pycache__/a.py"]


@pytest.mark.parametrize("name", sorted(WALKS))
def test_walks_agree_as_columns(spark, name):
    walk = WALKS[name]
    given = spark.createDataFrame([(p, n) for p in PATHS for n in (0, MIB, MIB + 1)], "path string, size long")
    assert all(r["t"] == walk.takes(r["path"], r["size"]) for r in given.withColumn("t", walk.taken(F.col("path"), F.col("size"))).collect())
    assert walk.takes("a.js", MIB) and walk.takes("a.js", MIB + 1) == (name != "tree") and walk.takes("dist/a.js", 1) == (name == "archive")


def test_batches_are_bounded_in_bytes(tmp_path):
    """Texts of three bytes a character: what a task holds follows bytes, when archives are read and when they are written."""
    text = "\u4e2d" * (MIB // 3)
    packed(tmp_path / "wide-1.tgz", [(f"package/m{k}.js", text.encode()) for k in range(12)])
    reader = archives.ArchiveReader({"path": str(tmp_path)})
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in read) == 12 and max(b.nbytes for b in read) <= 4 * MIB
    batch = pa.RecordBatch.from_pydict({"content": [text, None, "", *[text] * 8]})
    cut = list(archives.pieces(batch, "content"))
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict() and all(sum(len((t or "").encode()) for t in c.column(0).to_pylist()) <= archives.BATCH for c in cut)
    assert len(cut) > 3 and list(archives.pieces(batch.slice(0, 0), "content")) == []
