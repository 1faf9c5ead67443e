from __future__ import annotations

import hashlib
import random
import re

import pytest

from bazaarlens.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(documents, items):
    """Every window of every item at every place of every text."""
    windows = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        for at in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[at : at + 10]), set()).add(item)
    out = []
    for doc, text in documents:
        w, hit, found = WORD.findall(lowered(text)), set(), set()
        for window, ids in windows.items():
            for at in range(len(w) - len(window) + 1):
                if tuple(w[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    found |= ids
        names = ",".join(sorted(str(i) for i in found if i is not None))
        n = sum(i is not None for i in found)
        out.append((doc, len(w), len(hit), n, hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "É", "é", "x1", "2", "ünd", "東京", "a", "of"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n", "\x00", "_"]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 30]) if i % 5 else 14)) for i in range(20)]
    items += [(5, "second text of an id that repeats"), (99, items[0][1].upper()), (None, "owned by nobody at all"), (77, None), (78, " .,; ")]
    documents = [(d, text(rng.randrange(60))) for d in range(40)]
    documents += [(100 + i, f"{text(7)} {t} {text(3)}") for i, (_, t) in enumerate(items)]
    documents += [(100, "shares an id"), (None, items[0][1]), (200, None), (201, ""), (202, "so OWNED-by nobody at all"), (203, items[0][1] * 3)]
    return documents, items


@pytest.mark.parametrize("windows", [100_000, 40])
def test_contamination_equals_the_plain_search(spark, make_documents, monkeypatch, windows):
    """With one automaton and with several."""
    monkeypatch.setattr(dc, "AUTOMATON_WINDOWS", windows)
    monkeypatch.setattr(dc, "SLICE_BYTES", 16)
    documents, items = cases()
    found = dc.contamination(make_documents(documents), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, found.collect()), key=str) == plain(documents, items)


@pytest.mark.parametrize("windows", [100_000, 3])
def test_spans_map_to_the_original_text(spark, make_documents, monkeypatch, windows):
    monkeypatch.setattr(dc, "AUTOMATON_WINDOWS", windows)
    item = "One two, three four five six seven eight nine TEN eleven twelve"
    text = f"Über <b>{item.upper()}</b>! und: {item.replace(' ', '--')}..."
    row = dc.find_items(make_documents([(1, text)]), spark.createDataFrame([(4, item)], ITEMS)).first()
    assert [text[s.start : s.stop] for s in row.spans] == [item.upper(), item.replace(" ", "--")]
    assert [(s["first"], s["last"]) for s in row.spans] == [(2, 13), (16, 27)] and row["items"] == [4]


def test_very_long_text_and_empty_tables(spark, make_documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = "w " * 1_500_000 + item + " " + "v" * 2_500_000 + " " + item
    found = dc.contamination(make_documents([(1, text)]), spark.createDataFrame([(8, item)], ITEMS)).first()
    assert (found.n_words, found.n_hit, found.n_items) == (1_500_021, 20, 1)
    nothing = spark.createDataFrame([], ITEMS)
    assert dc.contamination(make_documents([(1, item)]), nothing).first().n_hit == 0
    assert dc.contamination(make_documents([(1, "a")]).limit(0), nothing).count() == 0
