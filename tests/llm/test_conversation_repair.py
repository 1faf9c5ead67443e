from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import conversation_repair as cr
from bazaarlens.llm import queries

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Cost, edits and repaired turns by one forward pass that keeps the least (cost, edits) of each state.

    ``rows`` are (role, text, fault)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    def insertions(best):
        for _ in range(3):
            for state, (cost, edits, out) in list(best.items()):
                for new in (n for n in after[state].values() if n in full):
                    option = (cost + 2, edits + "I", out + (full[new] + ":",))
                    best[new] = min(best.get(new, option), option)
        return best

    best = insertions({"": (0, "", ())})
    for role, text, fault in rows:
        more = {}

        def put(state, option):
            more[state] = min(more.get(state, option), option)

        for state, (cost, edits, out) in best.items():
            put(state, (cost + 3, edits + "D", out))
            if fault in "bd":
                continue
            extra = fault == "t"
            if role[:1] in after[state]:
                put(after[state][role[:1]], (cost + extra, edits + "K", out + (f"{role}:{text}",)))
            for new in (n for n in after[state].values() if n in full):
                put(new, (cost + 2 + extra, edits + "R", out + (f"{full[new]}:{text}",)))
        best = insertions(more)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    """The contract's row for (turn, role, text) rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("b")
        elif (role, text) in seen:
            faults.append("d")
        else:
            faults.append("." if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "t")
        seen.add((role, text))
    cost, audit, out = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = zip([r[:1] for _, r, _ in rows], [r[:1] for _, r, _ in rows][1:])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
    counts = [faults.count(f) for f in "bdt"]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def ordered(rows):
    """By turn, nulls first, then role and a digest of the text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def compare(result, rows, originals=()):
    found = {r.conv_id: tuple(r)[1:] for r in result.collect()}
    by = {c: [] for c in originals}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    assert found == {conv: expected(ordered(own)) for conv, own in by.items()}


def random_turns(rng, convs, longest):
    texts = ["Yes.", "No!", "cut off", "So?  ", "", " \t\n", "Ünd.", "a.b", "x\n."]
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
            text = rng.choice([rng.choice(texts), f"t{rng.randrange(9)}."])
            rows.append((conv, turn + rng.randrange(2), role, text))
    return rows


def run(spark, rows, **more):
    return cr.audits(cr.repair(spark.createDataFrame(rows, TURNS).withColumns(more)))


def test_repair_equals_the_plain_search(spark):
    rows = random_turns(random.Random(1), range(150), 12)
    compare(run(spark, rows, at=F.lit("x"), kind=F.lit("x"), chunk=F.lit("x"), run=F.lit("x")), rows)


@pytest.mark.parametrize("roles", ["mixed", "user", "tool", "system", "pairs", "repeats"])
def test_one_conversation_over_many_chunks(spark, monkeypatch, roles):
    """Chunks of four rows: order that is lost at once, and sequences whose parity is never forgotten."""
    monkeypatch.setattr(cr, "CHUNK_BITS", 2)
    rng = random.Random(roles)
    rows = []
    for turn in range(181):
        role = {"mixed": rng.choice(["user", "assistant", "tool"]), "pairs": ("user", "assistant")[turn % 2]}.get(roles, roles)
        rows.append((7, turn, "user" if roles == "repeats" else role, "same." if roles == "repeats" else f"t{turn}{rng.choice(['.', ''])}"))
    rows += [(3, 0, "user", "Hi."), (9, 0, "assistant", "Hi.")] + random_turns(rng, (4, 5, 8), 20)
    compare(run(spark, rows), rows)


def test_nulls_ties_and_conversations_without_turns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, None, "assistant", "b."), (1, 5, "user", "q."), (1, 5, "user", "q."), (1, 5, "assistant", "r")]
    filled = [tuple(" " if v is None and k > 1 else v for k, v in enumerate(r)) for r in rows]
    compare(run(spark, rows), filled)
    table = spark.createDataFrame(rows, TURNS)
    none = cr.audits(cr.repair(table.limit(0), table.select("conv_id")))
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in none.collect()) == [("1", 0, 0, 0, 0, 0, 0, "", empty), ("None", 0, 0, 0, 0, 0, 0, "", empty)]
    assert cr.audits(cr.repair(table.limit(0))).count() == 0


def test_repaired_turns_and_a_very_long_text(spark):
    rows = [(1, 0, "assistant", "x" * 2_000_000 + "."), (1, 1, "user", "Hi."), (1, 2, "user", " "), (2, 0, "user", "Hm.")]
    out = cr.repair(spark.createDataFrame(rows, TURNS)).where("edit is not null").collect()
    turns = sorted((r.conv_id, r.place, r.role, r.edit, len(r.text)) for r in out if r.place is not None)
    one = [(1, 0, "user", "I", 0), (1, 1, "assistant", "K", 2_000_001), (1, 2, "user", "K", 3), (1, 3, "assistant", "I", 0)]
    assert turns == [*one, (2, 0, "user", "K", 3), (2, 1, "assistant", "I", 0)]
    assert [(r.turn, r.fault) for r in out if r.edit == "D"] == [(2, "b")]


def test_damage_and_the_whole_query(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op11_parallel_viterbi(spark, data_dir), damaged(rows), {r[0] for r in rows})
    table = spark.createDataFrame([(None, None, "user", None), (None, 4, None, "a.b!")] + [(c, t, "assistant", "Oh?") for c in range(9) for t in range(9)], TURNS)
    found = sorted(map(str, (tuple(r)[:4] for r in cr.damage(table).collect())))
    assert found == sorted(map(str, damaged([tuple(r) for r in table.collect()])))


def test_real_cost_vectors_stay_within_the_speculative_ones():
    kinds = [i + f for i in ("s", "u", "a", "x", "") for f in ".bt"]
    open_, seen = [cr.ENDED], {cr.ENDED}
    while open_:
        after = open_.pop()
        assert max(after) - min(after) < cr.FAR
        for before in {cr.normal(cr.backward(k, after)) for k in kinds} - seen:
            seen.add(before)
            open_.append(before)
    assert len(seen) < 200
