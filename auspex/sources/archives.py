"""Packages in tar archives as a Spark data source, and archives written by Spark.

``ArchiveSource`` lists the archives below a folder, packs them into partitions by
their bytes and streams each one twice: once for its layout, whether it is
whole, its name and version; then for the texts of the files that the walk takes.
An archive is never unpacked to disk, and a task holds one file and one batch.
So a lost task reads its own archives again and nothing else.

Defined cases: an archive that is empty, no archive (or not compressed although its name
says so), cut off or that unpacks to more than ``most_unpacked`` bytes gives one row
with ``error`` and none of its files; a file of more than ``most_member`` bytes gives
a row with ``error`` and a null content; files that aren't UTF-8 are left out, and
so are links, other special members and paths that lead out of the archive; of
members with one path the last counts; a null name or content writes as empty.
"""

from __future__ import annotations

import gzip
import io
import itertools
import json
import posixpath
import re
import tarfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from auspex.sources.walks import WALKS, Walk

NAME = "package_archives"
COLUMNS = ("archive", "package_name", "version", "file_path", "content", "error")
ENDINGS = (".tgz", ".tar.gz", ".gz", ".tar")
#: Bytes of archives in a partition, of texts in a batch, and the most of an archive unpacked and of a file in it.
PARTITION, BATCH = 64 << 20, 2 << 20
MOST_UNPACKED, MOST_MEMBER = 8 << 30, 256 << 20
#: Bytes that headers between two members may have; long names need some thousand.
MOST_HEADER = 4 << 20
#: What tells that an archive is broken; other errors of reading fail the task, so that it is tried again.
BROKEN = (tarfile.TarError, gzip.BadGzipFile, EOFError, zlib.error)


class TooLarge(Exception):
    pass


class Metered:
    """A stream that refuses to give more than ``allowed`` bytes since it was last set, and ``left`` in all."""

    def __init__(self, raw: BinaryIO, left: int):
        self.raw, self.left, self.allowed = raw, left, MOST_HEADER

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(n)
        self.left -= len(data)
        self.allowed -= len(data)
        if min(self.left, self.allowed) < 0:
            raise TooLarge
        return data


def members(opened: Callable[[], BinaryIO], packed: bool, most_unpacked: int) -> Iterator[tuple[int, str, tarfile.TarInfo, tarfile.TarFile]]:
    """Number, path, head and archive of each file, read as a stream to the very end, where a compressed one has its checksum."""
    with opened() as raw:
        stream = Metered(gzip.GzipFile(fileobj=raw) if packed else raw, most_unpacked)
        with tarfile.open(fileobj=stream, mode="r|") as tar:
            number = 0
            while (info := tar.next()) is not None:
                tar.members.clear()  # heads already seen
                stream.allowed = info.size + MOST_HEADER
                parts = [p for p in info.name.split("/") if p not in ("", ".")]
                if info.isreg() and parts and ".." not in parts:
                    yield number, "/".join(parts), info, tar
                number += 1
        stream.allowed = most_unpacked
        while stream.read(1 << 20):
            pass


class Layout(NamedTuple):
    root: str
    last: dict[str, int]
    manifest: bytes | None


def layout(opened: Callable[[], BinaryIO], packed: bool, walk: Walk, most_unpacked: int) -> Layout:
    """The folder that is scanned (``package/`` where there is one), the members that count and the manifest."""
    found: dict[str, int] = {}
    manifests: dict[str, bytes] = {}
    inner = False
    for number, path, info, tar in members(opened, packed, most_unpacked):
        inner |= path.startswith("package/")
        if walk.takes(path, info.size):
            found[path] = number
        if path in ("package.json", "package/package.json") and info.size <= MOST_HEADER:
            manifests[path] = tar.extractfile(info).read()
    root = "package/" if inner else ""
    return Layout(root, {p: n for p, n in found.items() if p.startswith(root)}, manifests.get(root + "package.json"))


def identity(file_name: str, manifest: bytes | None) -> tuple[str, str]:
    """Name and version by the file's name, cut at its last hyphen, else by the manifest."""
    stem = file_name.rsplit(".", 1)[0].removesuffix(".tar")
    name, hyphen, version = stem.rpartition("-")
    if name and hyphen and version:
        return name, version
    try:
        told = json.loads(manifest or b"")
    except ValueError:
        return stem, "unknown"
    text = lambda key, other: told[key] if isinstance(told, dict) and isinstance(told.get(key), str) else other
    return text("name", "unknown"), text("version", "0.0.0")


def archive_rows(archive: str, opened: Callable[[], BinaryIO], walk: Walk, wanted: Callable[[str | None], bool], most_unpacked: int = MOST_UNPACKED, most_member: int = MOST_MEMBER) -> Iterator[tuple]:
    """COLUMNS of the files of one archive whose path is ``wanted``."""
    file_name = posixpath.basename(archive)
    packed = file_name.endswith("gz")
    try:
        plan = layout(opened, packed, walk, most_unpacked)
    except (*BROKEN, TooLarge) as problem:
        if wanted(None):
            kind = "too large" if isinstance(problem, TooLarge) else "unreadable"
            yield archive, *identity(file_name, None), None, None, kind
        return
    name, version = identity(file_name, plan.manifest)
    for number, path, info, tar in members(opened, packed, most_unpacked):
        short = path[len(plan.root) :]
        if plan.last.get(path) != number or not wanted(short):
            continue
        if info.size > most_member:
            yield archive, name, version, short, None, "too large"
            continue
        try:
            yield archive, name, version, short, tar.extractfile(info).read().decode(), None
        except UnicodeDecodeError:
            continue


def located(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Archives(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.walk = WALKS[options.get("walk", "archive")]
        self.most_unpacked, self.most_member = int(options.get("most_unpacked", MOST_UNPACKED)), int(options.get("most_member", MOST_MEMBER))
        self.partition = int(options.get("partition_bytes", PARTITION))
        self.asked: list[tuple[str, str, object]] = []

    def passes(self, column: str, value: str | None) -> bool:
        tests = {"is": lambda x: value == x, "in": lambda x: value in x, "starts": lambda x: value.startswith(x), "ends": lambda x: value.endswith(x), "has": lambda x: x in value}
        return all(value is not None and tests[kind](x) for c, kind, x in self.asked if c == column)

    def partitions(self) -> list[Archives]:
        fs, where = located(self.path)
        scheme = self.path[: len(self.path) - len(where)] if "://" in self.path else ""
        found = [i for i in fs.get_file_info(pafs.FileSelector(where, recursive=True)) if i.is_file and i.base_name.endswith(ENDINGS) and not i.base_name.startswith((".", "_"))]
        out, size = [Archives([])], 0
        for info in sorted(found, key=lambda i: i.path):
            if not self.passes("archive", scheme + info.path):
                continue
            if out[-1].paths and size + info.size > self.partition:
                out.append(Archives([]))
                size = 0
            out[-1].paths.append(scheme + info.path)
            size += info.size
        return out

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        schema = pa.schema([(c, pa.string()) for c in COLUMNS])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)
        for archive in partition.paths:
            fs, where = located(archive)
            for row in archive_rows(archive, lambda fs=fs, where=where: fs.open_input_stream(where), self.walk, lambda p: self.passes("file_path", p), self.most_unpacked, self.most_member):
                held.append(row)
                size += len((row[4] or "").encode()) + 256
                if size >= BATCH:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


class FilteringReader(ArchiveReader):
    """Takes tests of archive and file_path into the listing and the walk, before any content is read."""

    KINDS = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            kind = self.KINDS.get(type(f))
            if kind and len(f.attribute) == 1 and f.attribute[0] in ("archive", "file_path"):
                self.asked.append((f.attribute[0], kind, f.value))
            else:
                yield f


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> ArchiveReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else ArchiveReader)(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """COLUMNS of the archives below ``path``; filters go down where the session lets Python sources have them."""
    spark.dataSource.register(ArchiveSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).options(pushdown=pushdown, **options).load(path)


def pieces(batch: pa.RecordBatch, column: str, limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batch cut where ``column`` has ``limit`` bytes, a row at least: its rows become Python values a piece at a time."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def write_archives(rows: DataFrame, path: str) -> int:
    """Write (archive, member, content) as one file an archive below ``path``, compressed unless ``plain``; returns how many.

    An archive is written as a stream by one task, under a name of its attempt, and
    moved to its own name when it is whole, so that tasks may be tried again.
    """
    fs, where = located(path)
    fs.create_dir(where, recursive=True)
    dealt = rows.select("archive", "plain", "member", F.coalesce("content", F.lit("")).alias("content")).repartition("archive").sortWithinPartitions("archive", "member")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = located(path)
        attempt = TaskContext.get().taskAttemptId()
        current, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if current is not None:
                for part in parts:
                    part.close()
                fs.move(f"{where}/.{attempt}-{current}", f"{where}/{current}")
                yield pa.RecordBatch.from_pydict({"archive": [current]})

        for batch in itertools.chain.from_iterable(pieces(b, "content") for b in batches):
            for archive, plain, member, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "plain", "member", "content")), strict=True):
                if archive != current:
                    yield from close()
                    current = archive
                    raw = fs.open_output_stream(f"{where}/.{attempt}-{archive}")
                    packed = [] if plain else [gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0)]
                    parts = [tarfile.open(fileobj=(packed or [raw])[0], mode="w|"), *packed, raw]
                data = content.encode()
                info = tarfile.TarInfo(member)
                info.size = len(data)
                parts[0].addfile(info, io.BytesIO(data))
                parts[0].members.clear()
        yield from close()

    return dealt.mapInArrow(run, "archive string").count()


def whole(rows: DataFrame) -> DataFrame:
    """package_name, file_path, content of the files that were read: what the detectors take."""
    return rows.where("error is null").select("package_name", "file_path", "content")
