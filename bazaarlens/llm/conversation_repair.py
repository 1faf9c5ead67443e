"""Repair of conversations: cheapest edits to a legal order of roles, by a Viterbi search in parallel chunks.

A conversation is legal if the initials of its roles are empty or an optional system turn
followed by pairs of user and assistant turns. States of the search are what the repaired
turns so far end with: nothing, a system turn, a user turn, an assistant turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm.staging import staged

#: Rows of a chunk, which one task searches by itself.
CHUNK_BITS = 12
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with this initial, where it is legal.
LEGAL = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state after an inserted or renamed turn, and the role such a turn gets.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
KEEP, DELETE, INSERT, RENAME, TRUNCATED = 0, 3, 2, 2, 1
#: More than the costs from two states can differ by once turns may be inserted: a path from the
#: start state can be followed from the user state by one insertion, one deletion and one more
#: insertion (7 from the system state); every real cost vector lies within it.
FAR = 8
#: Costs from each state once all rows are read.
ENDED = (0, 4, 2, 0)
FINE, BLANK, DUPLICATE, CUT = ".", "b", "d", "t"


@lru_cache(maxsize=None)
def backward(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each state before a row, given those after it. ``kind`` is the row's initial and fault."""
    initial, fault = kind[:-1], kind[-1]
    cost = [DELETE + a for a in after]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for state in range(4):
            cost[state] = min(cost[state], RENAME + more + after[NEXT[state]])
            if initial in LEGAL[state]:
                cost[state] = min(cost[state], KEEP + more + after[LEGAL[state][initial]])
    cost[USER], cost[ASSISTANT] = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    for state in (START, SYSTEM):
        cost[state] = min(cost[state], INSERT + cost[USER])
    return tuple(cost)


def normal(costs: tuple[int, ...]) -> tuple[int, ...]:
    """The same costs up to a constant, the least one 0."""
    least = min(costs)
    return tuple(c - least for c in costs)


@lru_cache(maxsize=None)
def edits(kind: str, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least of the cheapest edits at one row, with the insertions before it, and the state after it."""
    before, letters = backward(kind, after), ""
    initial, fault = kind[:-1], kind[-1]
    more = TRUNCATED if fault == CUT else 0
    while True:
        if before[state] == DELETE + after[state]:
            return letters + "D", state
        if before[state] == INSERT + before[NEXT[state]]:
            letters, state = letters + "I", NEXT[state]
            continue
        kept = LEGAL[state].get(initial)
        if kept is not None and before[state] == KEEP + more + after[kept]:
            return letters + "K", kept
        return letters + "R", NEXT[state]


def vectors(kinds: list[str], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Normalised cost vectors before each row, and ``after`` itself as the last."""
    out = [normal(after)]
    for kind in reversed(kinds):
        out.append(normal(backward(kind, out[-1])))
    return out[::-1]


def trace(kinds: list[str], costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """Edits of a run of rows from ``state`` on, and the state after them; the last run of a
    conversation inserts what is missing at its end."""
    out = []
    for kind, after in zip(kinds, costs[1:], strict=True):
        letters, state = edits(kind, after, state)
        out.append(letters)
    while last and state in (SYSTEM, USER):
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def _runs(conv: list) -> list[tuple[int, int]]:
    """Runs of rows of one conversation in a chunk (null ids are one conversation)."""
    cut = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _within(costs: np.ndarray) -> np.ndarray:
    """Costs (last axis: states) with none above FAR more than the least."""
    return np.minimum(costs, costs.min(-1, keepdims=True) + FAR)


def _speculative(chunk: pa.Table) -> pa.Table:
    """Cost vectors before the first and the last run of a chunk, which may go on in other
    chunks, for four speculative vectors after it: each is 0 in one state and FAR elsewhere.
    ``m`` holds the four vectors one after another."""
    chunk = chunk.sort_by("at")
    conv, kind, number = (chunk.column(c).to_pylist() for c in ("conv_id", "kind", "chunk"))
    runs, out = _runs(conv), []
    for which, (a, b) in enumerate(dict.fromkeys((runs[0], runs[-1]))):
        kinds, m = kind[a:b], []
        for state in range(4):
            costs, constant = tuple(0 if s == state else FAR for s in range(4)), 0
            for kind in reversed(kinds):
                costs = backward(kind, costs)
                least = min(costs)
                costs, constant = tuple(min(c - least, FAR) for c in costs), constant + least
            m += [c + constant for c in costs]
        out.append((conv[a], number[a] * 2 + which, m))
    types = {"conv_id": chunk.column("conv_id").type, "run": pa.int64(), "m": pa.list_(pa.int64())}
    return _table(out, types)


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, types.items(), strict=True)})


def _fix_up(end: tuple[int, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Reruns speculative vectors from what is known after them: the vectors of the next runs
    (``m2``), or ``end`` behind the last run. ``done`` if all differ only by constants."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fixed, done = [], []
            for m, following, after in zip(frame["m"], frame["m2"], frame["next"], strict=True):
                own = np.array(m, np.int64).reshape(4, 4)
                if following is not None:
                    own = _within((np.array(following, np.int64).reshape(4, 4)[:, :, None] + own[None]).min(1))
                if pd.isna(after):
                    own = np.tile(_within((np.array(end)[:, None] + own).min(0)), (4, 1))
                shape = own - own[:, :1]
                fixed.append((own - own.min()).ravel().tolist())
                done.append(bool((shape == shape[0]).all()))
            yield pd.DataFrame({"run": frame["run"], "next": frame["next"], "m": fixed, "done": done})

    return run


def _converged(runs: DataFrame, end: tuple[int, ...]) -> DataFrame:
    """``run, v``: the normalised vector before each run of ``runs`` (run, next, m).

    A run whose speculative vectors differ only by constants has converged: its vector
    does not depend on what comes after. The others are rerun from the vectors of the run
    they point to and then point to where that one points, so even runs that never
    converge by themselves take a number of passes that is only the logarithm of their number.
    """
    schema = "run long, next long, m array<long>, done boolean"
    none = F.lit(None).cast("array<long>").alias("m2")
    table = staged(runs.select("run", "next", "m", none).mapInPandas(_fix_up(end), schema), "run-costs")
    while not table.where(~F.col("done")).isEmpty():
        known = table.select(F.col("run").alias("to"), F.col("next").alias("after"), F.col("m").alias("m2"))
        moved = table.where(~F.col("done")).join(known, F.col("next") == F.col("to"))
        moved = moved.select("run", F.col("after").alias("next"), "m", "m2").mapInPandas(_fix_up(end), schema)
        table = staged(table.where("done").union(moved), "run-costs")
    first = F.slice("m", 1, 4)
    return table.select("run", F.transform(first, lambda c: (c - F.array_min(first)).cast("int")).alias("v"))


def _traced(chunk: pa.Table, known: pa.Table) -> pa.Table:
    """Edits of each run of a chunk. ``known`` has the vector after runs that go on in other
    chunks; such a run is traced from each state it may start in."""
    chunk = chunk.sort_by("at")
    conv, kind, at, number = (chunk.column(c).to_pylist() for c in ("conv_id", "kind", "at", "chunk"))
    shared = {r: (tuple(v), last) for r, v, last in zip(*[known.column(c).to_pylist() for c in ("run", "v", "last")], strict=True)}
    runs, out = _runs(conv), []
    for a, b in runs:
        run = number[a] * 2 + (a > 0)  # only the first and the last run can be shared
        run = run if run in shared and (a == 0 or b == len(conv)) else None
        after, last = shared.get(run, (ENDED, True))
        costs = vectors(kind[a:b], after)
        traces = [trace(kind[a:b], costs, state, last) for state in (range(4) if run is not None else (START,))]
        faults = "".join(k[-1] for k in kind[a:b])
        out.append((conv[a], run, at[a], [t[0] for t in traces], [t[1] for t in traces], faults))
    types = {"conv_id": chunk.column("conv_id").type, "run": pa.int64(), "at": pa.int64()}
    types |= {"audits": pa.list_(pa.string()), "ends": pa.list_(pa.int32()), "faults": pa.string()}
    return _table(out, types)


def _faulty(turns: DataFrame) -> DataFrame:
    """``conv_id, at, chunk, kind`` of all rows; ``at`` ascends along each conversation and counts up inside a chunk."""
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    narrow = turns.select(
        "conv_id",
        "turn",
        "role",
        "copy",
        _digest().alias("digest"),
        F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT).alias("fault"),
    )
    order = ["conv_id", "turn", "role", "digest", "copy"]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(placed.withColumn("at", F.monotonically_increasing_id()), "turns")
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    blank = F.col("fault") == BLANK
    fault = F.when(blank | F.col("first"), F.col("fault")).otherwise(DUPLICATE)
    kind = F.concat(F.substring("role", 1, 1), fault).alias("kind")
    found = placed.select("conv_id", "at", "role", "fault").join(first, "at", "left")
    return staged(found.select("conv_id", "at", F.shiftright("at", CHUNK_BITS).alias("chunk"), kind), "turn-kinds")


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _audits(turns: DataFrame) -> DataFrame:
    """``conv_id, at, audit, faults``: the edits and faults of each run of rows."""
    rows = _faulty(turns)
    runs = rows.groupBy("chunk").applyInArrow(_speculative, f"conv_id {dict(rows.dtypes)['conv_id']}, run long, m array<long>")
    runs = staged(runs, "runs")
    # One row per chunk and end of it; a window over a conversation sees one row per 4,096 of its turns.
    along = Window.partitionBy("conv_id").orderBy("run")
    linked = runs.select("run", "m", F.lead("run").over(along).alias("next"), F.lag("run").over(along).alias("previous"))
    linked = staged(linked.where(F.col("next").isNotNull() | F.col("previous").isNotNull()), "shared-runs")
    costs = _converged(linked, ENDED)
    after = linked.join(costs.select(F.col("run").alias("next"), "v"), "next", "left").select(
        F.shiftright("run", 1).alias("chunk"),
        "run",
        F.coalesce("v", F.array(*[F.lit(c) for c in ENDED])).alias("v"),
        F.col("next").isNull().alias("last"),
    )
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, run long, at long, audits array<string>, ends array<int>, faults string"
    traced = staged(rows.groupBy("chunk").cogroup(after.groupBy("chunk")).applyInArrow(_traced, schema), "traces")
    # The state a run starts in follows from those before it, by the same passes in the other direction.
    single = [F.when(F.col("previous").isNull(), s).alias(f"s{s}") for s in range(4)]
    ends = traced.where(F.col("run").isNotNull()).select(F.col("run").alias("previous"), "ends")
    starts = linked.select("run", "previous", *single).join(ends, "previous", "left")
    to = F.coalesce("ends", F.array(*[f"s{s}" for s in range(4)]))
    m = F.flatten(F.transform(to, lambda e: F.array(*[F.when(e == s, 0).otherwise(FAR).cast("long") for s in range(4)])))
    states = _converged(starts.select("run", F.col("previous").alias("next"), m.alias("m")), tuple(0 if s == START else FAR for s in range(4)))
    states = states.select("run", (F.array_position("v", 0) - 1).cast("int").alias("state"))
    audit = F.get("audits", F.coalesce("state", F.lit(0))).alias("audit")
    return traced.join(states, "run", "left").select("conv_id", "at", audit, "faults")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies edits to rows. Of each conversation come one row for itself, its runs of edits, and its turns."""
    conv: object = _edited
    edits_, faults, at, place, state = "", "", 0, 0, START
    for batch in batches:
        out: list[list] = [[] for _ in EDITED]

        def put(*values):
            for c, v in zip(out, values, strict=True):
                c.append(v)

        names = ("conv_id", "part", "turn", "role", "text", "audit", "faults")
        for own, part, turn, role, text, audit, fault in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            if own != conv or conv is _edited:
                conv, edits_, faults, at, place, state = own, [], [], 0, 0, START
            if part == 0:
                put(own, None, None, None, None, None, None, None)
                continue
            if part == 1:
                edits_.append(audit)
                faults.append(fault)
                continue
            if isinstance(edits_, list):
                edits_, faults, row = "".join(edits_), "".join(faults), 0
            while edits_[at] == "I":
                put(own, place, "I", None, None, None, ROLE[state], "")
                state, at, place = NEXT[state], at + 1, place + 1
            letter = edits_[at]
            if letter == "D":
                put(own, None, "D", faults[row], turn, role, None, None)
            else:
                name = role if letter == "K" else ROLE[state]
                state = LEGAL[state][role[:1]] if letter == "K" else NEXT[state]
                put(own, place, letter, faults[row], turn, role, name, text)
                place += 1
            at, row = at + 1, row + 1
            while row == len(faults) and at < len(edits_):
                put(own, place, "I", None, None, None, ROLE[state], "")
                state, at, place = NEXT[state], at + 1, place + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, batch.column(n).type if n in batch.schema.names else t) for c, (n, t) in zip(out, EDITED.items(), strict=True)],
            names=list(EDITED),
        )


EDITED = {
    "conv_id": pa.int64(), "place": pa.int64(), "edit": pa.string(), "fault": pa.string(), "turn": pa.int64(),
    "was": pa.string(), "role": pa.string(), "text": pa.string(),
}


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``conv_id, place, edit, fault, turn, was, role, text``: the turns after repair, with the edit of each.

    ``turns`` has conv_id, turn, role, text and may have ``copy`` (the order among equal
    rows); null roles and texts count as one space. ``conversations`` (conv_id) names
    conversations that may have no turns.

    A conversation's rows are ordered by turn (nulls first), then role and a digest of the
    text. A row's fault is blank (``b``: only white space), duplicate (``d``: same role and
    text earlier in the conversation), truncated (``t``: does not end in ``.``, ``!`` or
    ``?``) or none (``.``), the first that applies. Edits are to keep a row (K, costs 0), to
    rename its role to user or assistant (R, 2), to delete it (D, 3, blank and duplicate
    rows always), and to insert an empty user or assistant turn (I, 2); a truncated row that
    stays costs 1. The cheapest edits that make the order of roles legal are chosen, of
    these the ones whose letters sort first. ``place`` counts the turns after repair from
    0; deleted rows have none. One row without an edit stands for each conversation.

    The search runs backward over the rows in parallel: rows are numbered along
    conversations by a range sort and cut into chunks of bounded size. A run of rows that
    may go on in another chunk starts from speculative cost vectors, and passes fix it up
    until its vectors differ only by constants (:func:`_converged`). With the vector after
    each run known, every run is traced by itself from each state it may start in, and
    the states are stitched the same way. Only the last step, which applies the edits,
    reads each conversation in order in one task, as a sorted stream: it holds the
    conversation's edits (one letter a row) and no turns. The result is clustered by
    conversation and ordered in it.

    Null conv_ids are one conversation, as are null turns one turn. Tables without rows
    give none. Other columns are not read.
    """
    text = {c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}
    turns = turns.withColumns(text | ({} if "copy" in turns.columns else {"copy": F.lit(1)})).select("conv_id", "turn", "role", "text", "copy")
    runs = _audits(turns)
    everyone = turns if conversations is None else conversations
    order = ["turn", "role", "digest", "copy"]
    none = {c: F.lit(None).cast(t) for c, t in turns.dtypes} | {"at": F.lit(None).cast("long"), "digest": F.lit(None).cast("binary")}
    none |= {"audit": F.lit(None).cast("string"), "faults": F.lit(None).cast("string")}
    columns = ["conv_id", "part", "at", *order, "text", "audit", "faults"]

    def rows(df: DataFrame, part: int) -> DataFrame:
        return df.withColumn("part", F.lit(part)).withColumns({c: v for c, v in none.items() if c not in df.columns}).select(columns)

    stream = rows(everyone.select("conv_id").distinct(), 0).union(rows(runs, 1)).union(rows(turns.withColumn("digest", _digest()), 2))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at", *order)
    kinds = dict(turns.dtypes)
    schema = f"conv_id {kinds['conv_id']}, place long, edit string, fault string, turn {kinds['turn']}, was string, role string, text string"
    return stream.mapInArrow(_edited, schema)


#: Damage to a row, by the remainder of its hash.
DROP, EMPTY, UNPOINT, REPEAT, AS_USER, DAMAGES = 0, 1, 2, 3, 4, 20


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy``: turns with faults that a hash of their place decides. A fifth of
    them is dropped, emptied, stripped of ``.!?``, repeated or given to the user. Nulls count as one space."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    hit = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % DAMAGES
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return turns.where(hit != DROP).select(
        "conv_id",
        "turn",
        F.when(hit == AS_USER, "user").otherwise(role).alias("role"),
        F.when(hit == EMPTY, "").when(hit == UNPOINT, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(hit == REPEAT, 2).otherwise(1))).alias("copy"),
    )


AUDIT = {
    "conv_id": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
    "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(),
}


class _Audit:
    """Figures of one conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.turns, self.low, self.high, self.before = conv, 0, None, None, None
        self.faults, self.illegal, self.cost, self.letters, self.hash, self.lines = {}, 0, 0, [], hashlib.sha256(), 0

    def add(self, edit, fault, turn, was, role, text):
        self.letters.append(edit)
        self.cost += {"K": KEEP, "D": DELETE, "I": INSERT, "R": RENAME}[edit] + (TRUNCATED if fault == CUT and edit != "D" else 0)
        if edit != "I":
            self.faults[fault] = self.faults.get(fault, 0) + 1
            if self.before is not None:
                self.illegal += self.before + was[:1] not in ("su", "ua", "au")
            self.before = was[:1]
            if turn is not None:
                self.turns += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
        if edit != "D":
            self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
            self.lines += 1

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = [self.faults.get(f, 0) for f in (BLANK, DUPLICATE, CUT)]
        return (self.conv, gaps, *counts, self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest())


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = kind = None

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * len(AUDIT)
        types = AUDIT | {"conv_id": kind}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(AUDIT))

    for batch in batches:
        rows, kind = [], batch.column("conv_id").type
        names = ("conv_id", "edit", "fault", "turn", "was", "role", "text")
        for conv, edit, *values in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            if edit is None:
                if open_:
                    rows.append(open_.row())
                open_ = _Audit(conv)
            else:
                open_.add(edit, *values)
        yield batch_of(rows)
    if open_:
        yield batch_of([open_.row()])


def audits(repaired: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair`'s result: its faults, the cost and letters of the edits,
    and a digest of the repaired turns (``role:text``, joined by newlines), read in order as a stream."""
    schema = f"conv_id {dict(repaired.dtypes)['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return repaired.mapInArrow(_audited, schema)
