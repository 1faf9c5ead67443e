from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<double>, label int, block string, anchor string, positives string"


def make(spark, rows):
    """With extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "x", "x") for i, v, label in rows], VECTORS)


def plain(rows, anchor):
    """All scores of all anchors, in whole numbers."""
    v = {i: (label, [math.floor(256 * float(x)) for x in e]) for i, e, label in rows}
    out = []
    for a in filter(anchor, v):
        label, e = v[a]
        ranked = sorted((-sum(p * q for p, q in zip(e, w)), i, other) for i, (other, w) in v.items() if i != a)
        for score, p, _ in [r for r in ranked if r[2] == label][:5]:
            inside = [(-s, n) for s, n, other in ranked if other != label and 30 * -score <= 100 * -s <= 90 * -score]
            out += [(a, p, rank, n, -score, s) for rank, (s, n) in enumerate(inside[:10], 1)]
    return sorted(out)


def mined(spark, rows, every=3):
    found = hn.mine(make(spark, rows), F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("shape", ["even", "skewed", "tied", "opposed", "large"])
def test_mining_equals_all_scores(spark, monkeypatch, shape):
    monkeypatch.setattr(hn, "MIN_BLOCK_ROWS", 40)
    monkeypatch.setattr(hn, "BLOCKS", 4)
    monkeypatch.setattr(hn, "FIRST_LOOK", 2)
    monkeypatch.setattr(hn, "LOOK", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 20)) * (1.0 / np.arange(1, 21) if shape == "skewed" else 1)
    x += 0.5 if shape == "even" else 0
    if shape == "tied":
        x = np.round(x[rng.integers(0, 12, 300)] * 2) / 2
    if shape == "opposed":
        x = np.where(np.arange(300)[:, None] % 2, x, -np.abs(x))
    if shape == "large":
        x = np.round(x[:60] * 1e6)
    label = np.where(rng.random(len(x)) < 0.4, 0, rng.integers(1, 5, len(x)))
    rows = [(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, label))]
    found = mined(spark, rows)
    assert found == plain(rows, lambda i: i % 3 == 0)
    assert found or shape == "opposed"


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(6)
    good = [(i, (rng.random(4)).tolist(), i % 2) for i in range(12)]
    bad = [(30, None, 0), (33, [1, None, 1, 1], 0), (36, [1, float("nan"), 1, 1], 1), (39, [1, float("inf"), 1, 1], 1), (42, [1, 1, 1, 1], None), (45, [1, 1], 0), (None, [1, 1, 1, 1], 0)]
    zero = [(48, [0, 0, 0, 0], 0)]
    repeated = [(0, good[0][1], 0)] * 3
    assert mined(spark, good + bad + zero + repeated) == plain(good + zero, lambda i: i % 3 == 0)


def test_few_rows_and_none(spark):
    one = [(0, [1.0, 1.0], 3)]
    assert mined(spark, one) == [] and mined(spark, []) == []
    pair = one + [(1, [1.0, 0.5], 3), (2, [0.5, 0.25], 4)]
    assert mined(spark, pair) == plain(pair, lambda i: i % 3 == 0) != []
