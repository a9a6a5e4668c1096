"""Chat formatting by columnar byte assembly, and reading formatted chats back.

Every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside
roles and texts are escaped reversibly: backslashes are doubled, and a backslash
is put after the first character of every control string (and a role's line feed
becomes a backslash and ``n``), so that no control string is left.

Rows are dealt by conversation and sorted by turn.  Batches are assembled
without a loop over turns: segment lengths, cumulative offsets and scatter
indices in numpy copy headers, contents and trailers into one buffer, which
becomes the Arrow column as it is.  A conversation that spans batches comes out
as numbered parts, so no conversation is ever held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: Strings that a tokenizer of a chat model could take for marks (fixed values).
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Role whose texts are under the loss mask.
LEARNED = "assistant"
#: Turns assembled at once; bytes of a text that is copied as a slice; bytes that are copied by index at once.
TURNS, LONG, SCATTERED = 2048, 1 << 14, 1 << 20
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(\\?)")
_ESCAPED_ROLE = re.compile(r"\\([\\n]?)")


def escaped(texts: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(texts, "\\", "\\\\")
    for mark in CONTROLS:
        out = pc.replace_substring(out, mark, mark[0] + "\\" + mark[1:])
    return pc.replace_substring(out, "\n", "\\n") if role else out


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def unescaped_role(text: str) -> str:
    return _ESCAPED_ROLE.sub(lambda m: {"n": "\n"}.get(m[1], m[1]), text) if "\\" in text else text


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of binary values that starts at its first."""
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _scatter(out: np.ndarray, at: np.ndarray, column: pa.Array) -> None:
    """Copy the values of ``column`` to where ``at`` says: long ones as slices, short ones by index, so many bytes at once that the indices stay small."""
    data, offsets = _buffers(column)
    lengths, begins = np.diff(offsets), offsets[:-1]
    for k in np.flatnonzero(lengths > LONG):
        out[at[k] : at[k] + lengths[k]] = data[begins[k] : begins[k] + lengths[k]]
    short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    groups = np.cumsum(lengths[short]) // SCATTERED
    for rows in np.split(short, np.flatnonzero(np.diff(groups)) + 1):
        n = lengths[rows]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at[rows], n) + within] = data[np.repeat(begins[rows], n) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns, where each turn begins (one more than turns), and where its text begins and ends."""
    roles, texts = escaped(roles, role=True), escaped(texts)
    role_lengths, text_lengths = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (roles, texts))
    lengths = len(HEAD) + role_lengths + len(MIDDLE) + text_lengths + len(TAIL)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(begins[-1], np.uint8)
    role_at = begins[:-1] + len(HEAD)
    middle_at = role_at + role_lengths
    text_at = middle_at + len(MIDDLE)
    text_ends = text_at + text_lengths
    for at, mark in ((begins[:-1], HEAD), (middle_at, MIDDLE), (text_ends, TAIL)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, role_at, roles)
    _scatter(out, text_at, texts)
    return out, begins, text_at, text_ends


_FORMATTED = "conv_id long, part int, formatted string, loss_begins array<long>, loss_ends array<long>"


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, part = object(), 0
    for whole in batches:
        for first in range(0, whole.num_rows, TURNS):
            batch = whole.slice(first, TURNS)
            ids, roles = batch.column(0).to_pylist(), batch.column(1)
            out, begins, text_at, text_ends = assemble(roles, batch.column(2))
            starts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1])]
            cuts = begins[[*starts, len(ids)]]
            formatted = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(out)).cast(pa.string())
            learned = np.flatnonzero(pc.equal(roles, LEARNED).to_numpy(zero_copy_only=False))
            base = cuts[np.searchsorted(starts, learned, side="right") - 1]
            lists = pa.array(np.searchsorted(learned, [*starts, len(ids)]).astype(np.int32))
            parts = []
            for k in starts:
                part = part + 1 if ids[k] == current else 0
                current = ids[k]
                parts.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in starts], pa.int64()), pa.array(parts, pa.int32()), formatted, pa.ListArray.from_arrays(lists, pa.array(text_at[learned] - base)), pa.ListArray.from_arrays(lists, pa.array(text_ends[learned] - base))],
                ["conv_id", "part", "formatted", "loss_begins", "loss_ends"],
            )


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted conversations: ``conv_id``, ``part``, ``formatted``, ``loss_begins``, ``loss_ends`` (bytes of the part under the loss mask).

    The parts of a conversation, from 0, joined in order are its formatted text;
    only one that crosses a batch has more than one.  Null roles and texts count
    as empty, rows without a conversation form one of their own (null), null
    turns come first, and turns of equal number are ordered by role and text.
    Extra columns are ignored.  Rows with equal ``conv_id`` stay together and in
    order in the result's partitions.
    """
    chosen = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format_batches, _FORMATTED)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    current: list | None = None

    def close() -> None:
        if current is not None:
            done.append((current[0], current[1], current[2].hexdigest(), current[3], current[4].hexdigest(), current[5]))

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        for conv, part, formatted, begins, ends in zip(*(c.to_pylist() for c in b.columns)):
            if part == 0:
                close()
                current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            data = formatted.encode()
            for m in _TURN.finditer(data):
                current[1] += 1
                current[2].update(f"{unescaped_role(m[1].decode())}\n{unescaped(m[2].decode())}\n".encode())
            for s, e in zip(begins, ends):
                text = unescaped(data[s:e].decode())
                current[3] += len(text)
                current[4].update(text.encode())
            current[5] += len(formatted)
        if done:
            yield batch()
    close()
    if done:
        yield batch()


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse what ``format_chats`` returned: one row of counts and digests per conversation."""
    return formatted.mapInArrow(_digest_batches, _DIGESTS)
