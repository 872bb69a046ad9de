r"""WARC archives of pages, and their index by an external merge.

Writing: the pages are joined with the smallest page_id of each payload; that page
becomes a response record, the others revisit records that refer to it.  A record
is one string (headers, HTTP headers, payload), and Spark's text writer makes the
gzipped archives in the shared folder: its line separator, two line feeds with
carriage returns, is the end of a WARC record.

Reading: a task gets the pieces of an archive in order, puts the bytes together
again and cuts them by Content-Length, so payloads may hold the separator.

Index: the captures of each archive are sorted by URL key, time and page where
they were read, and written: a run.  The key space is cut in ranges of about
``MERGE_ROWS`` captures by all three, so a hot URL spreads over many tasks; each
takes its slices of all runs as they come, without sorting them again, and merges
them by a loser tree.  A slice ends where the key falls, so the order in which
slices come, and even a slice in pieces, changes nothing.  The ranges in order are
the globally ordered capture histories.

Defined cases: a null html is the empty payload; a null url has no target URI and
the empty key; line breaks in a url are percent-encoded; with a null page_id in a
group, the smallest other one is the response; rows that repeat the smallest
page_id of a payload are responses like it; a page's time is derived from its id,
as the table has none; a very long html is held whole by the task that reads it; an
empty table gives empty archives and an empty index.  Extra columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auspex.sources.shared import join_keyed, materialize, new_path

CRLF = "\r\n"
END = CRLF * 2
#: Captures that one merge task gets on average.
MERGE_ROWS = 50_000
#: Time of the page with id 0; a page's is so many seconds later as its id says.
EPOCH = 1_704_067_200


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 bytes of the digest are 8 digits."""
    hex_ = F.sha1(data)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hex_, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """The URL with its host's labels reversed, without scheme, user, www, port and fragment, its query sorted."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/:?]*)", 1)), r"^www\d*\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1)
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")), "&")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url == "", "").otherwise(key)


def records(pages: DataFrame) -> DataFrame:
    """One WARC record per page, as a string."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("same", F.sha2("payload", 256))
    firsts = materialize(p.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    p = join_keyed(p, firsts, "same", "n")
    response = F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    length = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length.cast("string"), F.lit(END))
    block = F.concat(http, F.when(response, F.col("payload")).otherwise(""))
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    return p.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            header("WARC-Type", F.when(response, "response").otherwise("revisit")),
            header("WARC-Record-ID", urn(F.col("page_id"))),
            header("WARC-Date", F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            header("WARC-Target-URI", F.col("url")),
            header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload").cast("binary")))),
            header("WARC-Refers-To", F.when(~response, urn(F.col("first")))),
            F.when(response, "").otherwise(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
            F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
            F.octet_length(block).cast("string"),
            F.lit(END),
            block,
        ).alias("record")
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzipped WARC files of all pages in the folder ``path``."""
    records(pages).write.option("lineSep", END).option("compression", "gzip").text(path)


CAPTURE = "archive string, position long, page_id long, url string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")
_URN = re.compile(r"<urn:page:(-?\d+)>")


def _capture(archive: str, position: int, head: bytes, block: bytes) -> tuple:
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    page = lambda name: int(m[1]) if (m := _URN.fullmatch(fields.get(name, ""))) else None
    http, _, payload = block.partition(END.encode())
    size, digest = int(_LENGTH.search(http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), found) != (size, digest):
            raise ValueError(f"{archive}: the record at {position} doesn't match its digest")
    return (archive, position, page("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Date"], fields["WARC-Type"], size, digest, page("WARC-Refers-To"), payload)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record of the archives in ``path``; a revisit's size and digest are those its headers give."""
    # gzip files aren't split, so the pieces of one come in order, in one task
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    schema = CAPTURE + (", payload binary" if payload else "")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(len(names))], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, held, position, rows, size = None, bytearray(), 0, [], 0
        end = END.encode()
        for batch in batches:
            for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece"), strict=True):
                if file != archive:
                    if held:
                        raise ValueError(f"{archive} ends inside a record")
                    archive, position = file, 0
                held += piece.as_buffer()
                held += end
                while (at := held.find(end)) >= 0:
                    head = bytes(held[:at])
                    stop = at + 4 + int(_LENGTH.search(head)[1])
                    if len(held) < stop + 4:
                        break
                    rows.append(_capture(archive, position, head, bytes(held[at + 4 : stop])))
                    size += stop
                    position += stop + 4
                    del held[: stop + 4]
                if len(rows) >= 5000 or payload and size > 4 << 20:
                    yield table(rows)
                    rows, size = [], 0
        if held:
            raise ValueError(f"{archive} ends inside a record")
        yield table(rows)

    return pieces.mapInArrow(run, schema)


class LoserTree:
    """Merges k sorted lists: the root is the least head, each inner node the loser of the match played there."""

    def __init__(self, lists: list[list[tuple]]):
        self.lists, self.at, self.k = lists, [0] * len(lists), len(lists)
        self.heads = [x[0] if x else None for x in lists]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether a's head goes before b's; an ended list goes last, equal heads by their list's number."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the first to come here waits for its opponent
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, place in it) of all entries in order."""
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield w, self.at[w]
            self.at[w] += 1
            self.heads[w] = self.lists[w][self.at[w]] if self.at[w] < len(self.lists[w]) else None
            self._play(w)


ORDER = ("url_key", "captured", "page_id")


def merged(slices: DataFrame) -> DataFrame:
    """The rows of each partition, slices of sorted runs one behind the other, in the order of ORDER (null page_id first)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a range of about MERGE_ROWS
        if not held:
            return
        part = pa.Table.from_batches(held)
        heads = list(zip(part.column("url_key").to_pylist(), part.column("captured").to_pylist(), [(p is not None, p or 0) for p in part.column("page_id").to_pylist()], strict=True))
        first = [k for k in range(len(heads)) if k == 0 or heads[k] < heads[k - 1]]
        runs = [heads[a:b] for a, b in zip(first, [*first[1:], len(heads)], strict=True)]
        order = pa.array([first[r] + k for r, k in LoserTree(runs)], pa.int64())
        yield from part.take(order).combine_chunks().to_batches(max_chunksize=10_000)

    return slices.mapInArrow(run, slices.schema)


def merged_index(captures: DataFrame) -> DataFrame:
    """``captures`` with ``url_key``, range by range in the order of key, time and page."""
    runs = materialize(captures.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions(*ORDER), "warc-runs")
    ranges = max(1, -(-runs.count() // MERGE_ROWS))
    return merged(runs.repartitionByRange(ranges, *ORDER))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return merged_index(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


#: page_id to record_type as the archives must give them; DuckDB has no base32, so the digest's 5-byte groups are spelt out.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY 1),
h AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS d, first FROM p JOIN f USING (html)),
b AS (SELECT *, list_transform(range(4), lambda g: ('0x' || substr(d, 1 + 10 * g::INT, 10))::BIGINT) AS groups FROM h),
s AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#@]*@)?', '') AS rest FROM b),
u AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/:?]*)', 1)), '^www\\d*\\.', '') AS host, regexp_extract(rest, '^[^/?]*(/[^?]*)', 1) AS path,
  array_to_string(list_sort(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&')), '&') AS query FROM s)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((groups[1 + (k // 8)::INT] >> (35 - 5 * (k % 8))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  CASE WHEN url = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url_key,
  strftime(make_timestamp((page_id + 1704067200) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM u"""
