"""Chat formatting by columnar byte assembly.

Rows arrive sorted by conversation and turn. For each Arrow batch the byte lengths of all
headers, escaped contents and footers are known first; their cumulative sums give every
segment's place, and numpy copies the bytes of all rows into one preallocated buffer that
becomes the Arrow column of the result. No string is built per row.

Template of a turn: `<role>` newline content `</turn>` newline. `<`, `>` and `\\` inside roles and
contents get a `\\` before them, so an unescaped `<` starts a mark and nothing else does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare

ESCAPE = ord("\\")
ESCAPED = np.frombuffer(b"\\<>", np.uint8)
FOOT = b"</turn>\n"

PART_SCHEMA = "conv_id bigint, part int, formatted string, loss_from array<bigint>, loss_to array<bigint>"
_TURN = re.compile(rb"<((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)</turn>\n", re.S)
_ESCAPE = re.compile(rb"\\(.)", re.S)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def _escaped(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same column with an escape byte before each special byte."""
    special = np.isin(raw, ESCAPED)
    moved = np.cumsum(special)  # how far each byte moves to the right
    out = np.full(len(raw) + (int(moved[-1]) if len(raw) else 0), ESCAPE, np.uint8)
    out[np.arange(len(raw)) + moved] = raw
    return out, at + np.r_[0, moved][at]


def _scatter(out: np.ndarray, places: np.ndarray, raw: np.ndarray, at: np.ndarray) -> None:
    """Copy segment i of a column to out[places[i]:]."""
    sizes = np.diff(at)
    out[np.repeat(places - at[:-1], sizes) + np.arange(len(raw))] = raw


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each turn and the end, start and end of each content) of all turns."""
    n = len(roles)
    role, role_at = _escaped(*_bytes_of(roles))
    text, text_at = _escaped(*_bytes_of(texts))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    # segments of a turn: "<", role, ">\n", content, foot
    at = np.r_[0, np.cumsum(role_n + text_n + 3 + len(FOOT))]
    starts = at[:-1]
    out = np.empty(int(at[-1]), np.uint8)
    out[starts] = ord("<")
    _scatter(out, starts + 1, role, role_at)
    head = starts + 1 + role_n
    out[head] = ord(">")
    out[head + 1] = ord("\n")
    content = head + 2
    _scatter(out, content, text, text_at)
    foot = content + text_n
    out[foot[:, None] + np.arange(len(FOOT))] = np.frombuffer(FOOT, np.uint8) if n else 0
    return out, at, content, foot


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        out, at, content, foot = assemble(batch.column(1), batch.column(2))
        loss = np.array([r == "assistant" for r in batch.column(1).to_pylist()])
        first = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        bounds = [*first, len(ids)]
        parts, begins, ends = [], [], []
        for lo, hi in zip(bounds, bounds[1:]):
            part = part + 1 if (last is not None and last == (ids[lo],)) else 0
            last = (ids[lo],)
            parts.append(part)
            at_loss = np.flatnonzero(loss[lo:hi]) + lo
            begins.append((content[at_loss] - at[lo]).tolist())
            ends.append((foot[at_loss] - at[lo]).tolist())
        column = pa.LargeStringArray.from_buffers(
            len(first), pa.py_buffer(np.ascontiguousarray(at[bounds]).astype(np.int64)), pa.py_buffer(out))
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in first], pa.int64()), pa.array(parts, pa.int32()), column.cast(pa.string()),
             pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
            names=["conv_id", "part", "formatted", "loss_from", "loss_to"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss_from, loss_to: one row per conversation.

    turns: conv_id, turn, role, text. `loss_from` and `loss_to` are byte positions in `formatted`
    between which the loss counts: the contents of assistant turns. A conversation longer than an
    Arrow batch comes in consecutive parts (0, 1, …) in the same partition, in order, so no task
    ever holds a whole one; the text of a conversation is its parts joined.

    Null text or role is empty. Equal turn numbers are ordered by role, then text; null turns come
    first. Rows with a null conv_id form one conversation. Repeated rows are repeated turns. An
    empty table gives an empty result; other columns are not looked at.
    """
    prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text").mapInArrow(_parts, PART_SCHEMA))


def parse_turns(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted text; the reverse of the template."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at byte {at}")
        turns.append(tuple(_ESCAPE.sub(rb"\1", g).decode() for g in m.groups()))
        at = m.end()
    return turns


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, begins: list[int], ends: list[int]) -> None:
        raw = formatted.encode()
        for role, text in parse_turns(raw):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for lo, hi in zip(begins, ends):
            text = _ESCAPE.sub(rb"\1", raw[lo:hi])
            self.loss.update(text)
            self.loss_chars += len(text.decode())
        self.chars += len(formatted)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if k == "bigint" else pa.string()) for n, k in (c.split() for c in _DIGEST.split(", "))])
    now = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["part"] == 0:
                if now:
                    done.append(now.row())
                now = _Digest(row["conv_id"])
            now.add(row["formatted"], row["loss_from"], row["loss_to"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if now:
        yield pa.RecordBatch.from_pylist([now.row()], schema=schema)


def digests(parts: DataFrame) -> DataFrame:
    """Read formatted conversations back: turn count, digests of turns and of the text under the loss.

    parts: the result of format_conversations, not shuffled in between.
    """
    return parts.mapInArrow(_read_back, _DIGEST)
