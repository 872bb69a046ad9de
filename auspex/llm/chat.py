r"""Chat formatting by columnar byte assembly.

The turns are range-partitioned by conversation and turn and sorted, so that one
very long conversation spreads over many tasks.  A task lays its turns out in
numpy: the lengths of all segments (marks, role, text), their cumulative offsets
and the scatter indices of their bytes; headers and contents are then copied into
one preallocated Arrow buffer that becomes the column of formatted pieces.

A piece is a run of turns of one conversation, bounded in size: (conv_id, first
turn's place, formatted, loss spans, number of turns).  Concatenated in order, a
conversation's pieces are its formatted text; a short one is a single piece.

Texts may hold the template's own control strings.  Each one found gets a
backslash behind its first character (one more if it already has some), which
``unescape`` takes away, so any text comes back exactly.  In roles, backslashes
and line feeds are escaped too, since a line feed ends the role.

Defined cases: a null role or text is empty; turns are ordered by turn (null
first), then role, then text, so ties are in a fixed order; repeated rows are
repeated turns; a null conv_id is one conversation; extra columns take no part;
a very long text makes a piece of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auspex.llm import words as W
from auspex.sources.shared import materialize

#: A piece is closed once it has so many bytes.
PIECE_BYTES = 1 << 20
#: Pieces of one conversation that a task holds until it knows where the conversation ends.
HELD_BYTES = 16 << 20


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    #: Strings that chat models read as marks.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    loss_role: str = "assistant"

    def pattern(self, escaped: bool) -> str:
        """Of a control string with any number of backslashes in it, or one at least."""
        quote = lambda s: "".join(f"\\{c}" if c in "<>|[]/" else c for c in s)
        marks = "|".join(f"{quote(c[1:])}" for c in sorted(self.controls, key=len, reverse=True) if c[0] == "<")
        brackets = "|".join(f"{quote(c[1:])}" for c in sorted(self.controls, key=len, reverse=True) if c[0] == "[")
        slash = r"\\(\\*)" if escaped else r"(\\*)"
        return rf"(?:(<){slash}({marks})|(\[){slash}({brackets}))"

    def escape(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, self.pattern(False), r"\1\4\\\2\5\3\6")

    def unescape(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, self.pattern(True), r"\1\4\2\5\3\6")

    def escape_role(self, roles: pa.Array) -> pa.Array:
        plain = pc.replace_substring(pc.replace_substring(roles, "\\", r"\b"), "\n", r"\n")
        return self.escape(plain)

    def unescape_role(self, roles: pa.Array) -> pa.Array:
        return pc.replace_substring(pc.replace_substring(self.unescape(roles), r"\n", "\n"), r"\b", "\\")


CHATML = Template()

PIECES = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("formatted", T.BinaryType()),
    T.StructField("loss_spans", T.ArrayType(T.LongType())), T.StructField("n_turns", T.LongType()),
])


def scatter(out: np.ndarray, data: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
    """Copy the consecutive segments of ``data`` to their places in ``out``."""
    from_ = np.cumsum(lengths) - lengths
    out[np.repeat(to - from_, lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """One buffer with all turns, the n + 1 offsets of turns in it, and where each text begins and ends."""
    role, role_at = W.text_buffer(template.escape_role(roles))
    text, text_at = W.text_buffer(template.escape(texts))
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (template.begin, template.after_role, template.end)]
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = map(len, fixed)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    offsets = W.prefix(lengths.ravel())
    begins = offsets[:-1].reshape(n, 5)
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for column, mark in zip((0, 2, 4), fixed, strict=True):
        out[(begins[:, column, None] + np.arange(len(mark))).ravel()] = np.tile(mark, n)
    scatter(out, role, lengths[:, 1], begins[:, 1])
    scatter(out, text, lengths[:, 3], begins[:, 3])
    return buffer, offsets[::5], np.stack([begins[:, 3], begins[:, 3] + lengths[:, 3]], 1)


def _pieces(part: pa.RecordBatch, template: Template) -> pa.RecordBatch:
    """The turns of a slice, as pieces."""
    texts = [part.column(c).cast(pa.string()).fill_null("") for c in ("role", "text")]
    buffer, at, spans = assemble(*texts, template)
    conv = part.column("conv_id")
    turn = part.column("turn")
    key = conv.fill_null(0).to_numpy(zero_copy_only=False)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    opens = np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
    opens |= np.concatenate([[False], np.diff(at[:-1] // PIECE_BYTES) > 0])
    first = np.flatnonzero(opens)
    bounds = np.append(first, len(key))
    formatted = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at[bounds].astype(np.int64)), buffer])
    loss = np.flatnonzero(pc.equal(texts[0], template.loss_role).to_numpy(zero_copy_only=False))
    piece_of = np.searchsorted(first, loss, "right") - 1
    relative = (spans[loss] - at[first][piece_of, None]).ravel()
    cuts = np.searchsorted(loss, bounds) * 2
    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(relative))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), turn.take(pa.array(first)), formatted.cast(pa.binary()), lists, pa.array(np.diff(bounds))], PIECES.names)


def ranged(turns: DataFrame) -> DataFrame:
    """The turns in ranges of conversation and turn, sorted."""
    order = ["conv_id", "turn"]
    # the columns get names of their own, as extra ones may clash with them
    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return slim.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """PIECES of all conversations; ``seq`` orders the pieces of one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            yield _pieces(part, template)

    return ranged(turns).mapInArrow(run, PIECES).withColumn("seq", F.monotonically_increasing_id())


def parse(formatted: bytes, template: Template = CHATML) -> tuple[list[str], list[str]]:
    """Roles and texts of the turns in a piece."""
    begin, mid, end = template.begin.encode(), template.after_role.encode(), template.end.encode()
    turns = [t.split(mid, 1) for t in (p.removeprefix(begin) for p in formatted.split(end)[:-1])]
    roles = template.unescape_role(pa.array([t[0].decode() for t in turns], pa.string()))
    texts = template.unescape(pa.array([t[1].decode() for t in turns], pa.string()))
    return roles.to_pylist(), texts.to_pylist()


DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


class Reader:
    """DIGESTS of conversations whose pieces come one after the other, parsed from formatted text and loss spans."""

    def __init__(self, template: Template):
        self.template, self.now, self.rows = template, None, []

    def add(self, conv: int | None, formatted: bytes, spans: list[int]) -> None:
        now = self.now
        if now is None or now["id"] != conv:
            self.close()
            now = self.now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
        roles, texts = parse(formatted, self.template)
        for role, text in zip(roles, texts, strict=True):
            now["turns"].update(f"{role}\n{text}\n".encode())
        masked = self.template.unescape(pa.array([formatted[a:b].decode() for a, b in zip(spans[::2], spans[1::2], strict=True)], pa.string())).to_pylist()
        for text in masked:
            now["loss"].update(text.encode())
            now["chars"] += len(text)
        now["n"] += len(roles)
        now["all"] += len(formatted.decode())

    def close(self) -> None:
        if (now := self.now) is not None:
            self.rows.append((now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"]))
        self.now = None

    def flush(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([dict(zip(DIGESTS.names, r, strict=True)) for r in self.rows], OUT)
        self.rows.clear()
        return out


def read_back(pieces: DataFrame, template: Template = CHATML) -> DataFrame:
    """DIGESTS of each conversation of ``pieces``.

    A digest runs through a conversation from its start to its end, so its pieces
    stream through one task in order, one at a time.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(template)
        for batch in batches:
            for conv, formatted, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), batch.column("loss_spans").to_pylist(), strict=True):
                reader.add(conv, formatted.as_py(), spans)
            yield reader.flush()
        reader.close()
        yield reader.flush()

    return ordered.mapInArrow(run, DIGESTS)


def formatted_digests(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """DIGESTS of all conversations, formatted and read back where they are.

    Only the first and the last conversation of a range may go on in another one; the
    pieces of these are shuffled by conversation, the others aren't shuffled again.
    """
    names = [*DIGESTS.names, "formatted", "loss_spans"]
    schema = T.StructType([*DIGESTS.fields, PIECES["formatted"], PIECES["loss_spans"]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, first, opened = Reader(template), None, False
        held: list[tuple] = []  # pieces of the present conversation, as long as they are few: it may be the last

        def edges(pieces: list[tuple]) -> pa.RecordBatch:
            nulls = [pa.nulls(len(pieces), t) for t in OUT.types[1:]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int64()), *nulls, pa.array([p[1] for p in pieces], pa.binary()), pa.array([p[2] for p in pieces], pa.list_(pa.int64()))], names)

        def digests() -> pa.RecordBatch:
            out = reader.flush()
            return pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary()), pa.nulls(out.num_rows, pa.list_(pa.int64()))], names)

        for part in W.slices(batches, "text"):
            pieces = _pieces(part, template)
            for conv, formatted, spans in zip(pieces.column("conv_id").to_pylist(), pieces.column("formatted"), pieces.column("loss_spans").to_pylist(), strict=True):
                if not opened:
                    opened, first = True, conv
                if conv == first:
                    yield edges([(conv, formatted.as_py(), spans)])
                    continue
                if held and held[0][0] != conv:
                    for p in held:
                        reader.add(*p)
                    reader.close()
                    held = []
                held.append((conv, formatted.as_py(), spans))
                if sum(len(p[1]) for p in held) > HELD_BYTES:  # read back like one that goes on elsewhere
                    yield edges(held)
                    held, first = [], conv
            yield digests()
        if held:
            yield edges(held)

    found = materialize(ranged(turns).mapInArrow(run, schema).withColumn("seq", F.monotonically_increasing_id()), "digests")
    rest = found.where("formatted IS NOT NULL").select("conv_id", "formatted", "loss_spans", "seq")
    return found.where("formatted IS NULL").select(*DIGESTS.names).unionByName(read_back(rest, template))


OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return formatted_digests(turns.unionByName(planted))


def _escaped(column: str) -> str:
    """DuckDB: the length that escaping adds, a backslash for each control string."""
    return f"len(regexp_extract_all({column}, '{CHATML.pattern(False)}'))"


#: The same digests from the turns themselves; roles of the table hold no backslash or line feed.
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, role, txt, role, txt FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) AS p(k, role, txt))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
  sum(CASE WHEN role = '{CHATML.loss_role}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = '{CHATML.loss_role}'), '')) AS loss_sha256,
  sum({len(CHATML.begin) + len(CHATML.after_role) + len(CHATML.end)} + length(role) + {_escaped("role")} + length(text) + {_escaped("text")})::BIGINT AS formatted_chars
FROM t GROUP BY 1"""
