"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that models read as control; none survives in a formatted text but for the marks.
CONTROL = (
    TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>",
    "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
#: Word joiner. One breaks a control string; those of the text are doubled.
ESCAPE = "\u2060"
FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,length:long>>"
READ_BACK = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
#: Bytes of one output batch, unless one conversation alone has more.
BATCH_BYTES = 128 << 20


def escaped(texts: pa.Array) -> pa.Array:
    """Doubles the escape character, then puts one behind the first character of each control string.

    Runs of the escape character are even where they come from the text and of length one
    where they break a control string; no control string holds one. So it can be undone.
    """
    out = pc.replace_substring(texts, ESCAPE, ESCAPE * 2)
    for word in CONTROL:
        out = pc.replace_substring(out, word, word[0] + ESCAPE + word[1:])
    return out


def unescaped(text: str) -> str:
    parts = text.split(ESCAPE * 2)
    return ESCAPE.join(p.replace(ESCAPE, "") for p in parts)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_string array without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _contents(column: pa.ChunkedArray) -> pa.Array:
    return escaped(pa.concat_arrays(column.cast(pa.large_string()).chunks).fill_null(""))


def assemble(rows: pa.Table) -> pa.RecordBatch:
    """Formats whole conversations; ``rows`` (conv_id, role, text) are in order.

    A turn has five segments: mark, role, mark, text, mark. Their lengths give offsets by
    a cumulative sum; marks and contents are scattered into one buffer, which becomes the
    string column without a copy.
    """
    n = rows.num_rows
    ids = np.asarray(rows.column(0).fill_null(0)).astype(np.int64)
    null = np.asarray(rows.column(0).is_null())
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
    contents = [_bytes(_contents(rows.column(k))) for k in (1, 2)]
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (TURN, TEXT, END)]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0::2] = [len(m) for m in marks]
    lengths[:, 1], lengths[:, 3] = (np.diff(at) for at, _ in contents)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    buffer = np.empty(int(ends[-1, -1]), np.uint8)
    for k, mark in zip((0, 2, 4), marks, strict=True):
        buffer[begins[:, k, None] + np.arange(len(mark))] = mark
    for k, (at, data) in zip((1, 3), contents, strict=True):
        source = np.arange(at[0], at[-1])
        buffer[source + np.repeat(begins[:, k] - at[:-1], np.diff(at))] = data[source]
    edges = np.r_[begins[starts, 0], ends[-1, -1]]
    formatted = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(buffer)])
    turns = np.diff(np.r_[starts, n])
    own = np.repeat(edges[:-1], turns)
    loss = np.asarray(pc.equal(pc.fill_null(rows.column(1), ""), "assistant"))
    per = np.add.reduceat(loss.astype(np.int32), starts)
    spans = pa.StructArray.from_arrays(
        [pa.array((begins[:, 3] - own)[loss]), pa.array(lengths[loss, 3])], names=["start", "length"]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[starts], mask=null[starts]),
            pa.array(turns.astype(np.int64)),
            formatted,
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), spans),
        ],
        names=["conv_id", "n_turns", "formatted", "loss"],
    )


def _batches(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Assembles in pieces of bounded size, cut between conversations."""
    ids = rows.column(0)
    fresh = np.r_[True, ~np.asarray(pc.fill_null(pc.equal(ids[1:], ids[:-1]), False)) & ~np.asarray(pc.and_(ids[1:].is_null(), ids[:-1].is_null()))]
    size = np.asarray(pc.fill_null(pc.add(pc.binary_length(pc.fill_null(rows.column(1), "")), pc.binary_length(pc.fill_null(rows.column(2), ""))), 0)).astype(np.int64)
    starts = np.flatnonzero(fresh)
    total = np.cumsum(np.add.reduceat(size, starts))
    group = total // BATCH_BYTES
    cuts = np.r_[starts[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])], rows.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield assemble(rows.slice(a, b - a))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holds back the last conversation of a batch until the next one shows where it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist() if batch.num_rows < 2 else batch.column(0)
        last = ids[-1] if isinstance(ids, list) else ids[len(ids) - 1].as_py()
        same = np.asarray(ids.is_null() if last is None else pc.fill_null(pc.equal(ids, last), False)) if not isinstance(ids, list) else np.array([True])
        at = int(np.argmax(same))
        if at == 0 and held and held[-1].column(0)[held[-1].num_rows - 1].as_py() == last:
            held.append(batch)
            continue
        done = held + ([batch.slice(0, at)] if at else [])
        if done:
            yield from _batches(pa.Table.from_batches(done))
        held = [batch.slice(at)]
    if held:
        yield from _batches(pa.Table.from_batches(held))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss``.

    ``turns`` has conv_id, turn, role, text. Turns are ordered by turn (null first), then
    role, then text, so ties and repeated rows have one order; repeated rows stay. Null
    texts and roles are empty. Rows with a null conv_id form one conversation. Control
    strings inside roles and texts are escaped reversibly. ``loss`` holds the byte spans
    of assistant texts. Rows are dealt out and sorted by Spark and streamed; a task holds
    a batch and the conversation that runs on, which its one output string needs anyway.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_stream, FORMATTED)


def _parsed(formatted: bytes, loss: list[dict]) -> tuple[int, str, int, str, int]:
    text = formatted.decode()
    digest, n = hashlib.sha256(), 0
    for turn in text.split(TURN)[1:]:
        role, _, said = turn.partition(TEXT)
        digest.update(f"{unescaped(role)}\n{unescaped(said[: -len(END)])}\n".encode())
        n += 1
    learnt = "".join(unescaped(formatted[s["start"] : s["start"] + s["length"]].decode()) for s in loss)
    return n, digest.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            _parsed(f.as_buffer().to_pybytes(), spans.as_py())
            for f, spans in zip(batch.column("formatted"), batch.column("loss"), strict=True)
        ]
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and loss spans say, parsed from them alone."""
    return formatted.mapInArrow(_read_back, READ_BACK)
