from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaarlens.llm import multi_index, nearest, queries, vector_links

VECTORS = "vec_id long, embedding array<float>, label int, band string, cells string, n string"


def make(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "x", "x") for i, v, label in rows], VECTORS)


def clusters(seed, sizes, dim=16, labels=3):
    """Near copies around random directions, with cosines on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, size in enumerate(sizes):
        centre = rng.normal(size=dim)
        for _ in range(size):
            spread = rng.choice([0.02, 0.1, 0.2])
            rows.append((len(rows), (centre + spread * rng.normal(size=dim) * np.linalg.norm(centre) / 4).astype(np.float32), k % labels))
    rng.shuffle(rows)
    return rows


def brute_links(rows, cosine):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = (x @ x.T >= cosine) & (label[:, None] == label[None])
    np.fill_diagonal(links, False)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(links)):
        one, two = sorted((find(ids[a]), find(ids[b])))
        root[two] = one
    return {i: (int(links[k].sum()), find(i)) for k, i in enumerate(ids)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 9), min_size=1, max_size=7), st.lists(st.floats(0, 9), min_size=1, max_size=7))
def test_traversal_visits_every_cell_by_ascending_sum(one, two):
    found = list(multi_index.multi_sequence(np.array(one), np.array(two)))
    assert sorted((i, j) for _, i, j in found) == [(i, j) for i in range(len(one)) for j in range(len(two))]
    sums = [s for s, _, _ in found]
    assert sums == sorted(sums) and all(s == one[i] + two[j] for s, i, j in found)


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 9))
    index = multi_index.MultiIndex.fit(x, 6, 0)
    one, two = index.bounds(x)
    i, j = index.codes(x)
    for a in range(0, 200, 7):
        gap = ((x - x[a]) ** 2).sum(1)
        assert (one[a][i] + two[a][j] <= gap + 1e-9).all()


@pytest.mark.parametrize("block", [7, 512])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    """Also when every band is dealt into many blocks."""
    monkeypatch.setattr(vector_links, "BLOCK_ROWS", block)
    rows = clusters(1, [60, 40, 1, 1, 25] + [3] * 30)
    got = vector_links.link_vectors(make(spark, rows), 0.93).collect()
    expected = brute_links(rows, 0.93)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("sample", [16_384, 500])
def test_links_of_vectors_with_few_main_directions(spark, monkeypatch, sample):
    """Near copies differ along the data's own main directions; also with a sample of a part."""
    monkeypatch.setattr(vector_links, "SAMPLE_ROWS", sample)
    rng = np.random.default_rng(4)
    scale = 1 / np.arange(1, 65) ** 2
    rows = []
    for k in range(1500):
        v = rng.normal(size=64) * scale
        side = rng.normal(size=64) * scale
        side -= (side @ v) / (v @ v) * v
        c = rng.uniform(0.932, 0.95)
        w = c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
        rows += [(2 * k, v.astype(np.float32), k % 50), (2 * k + 1, w.astype(np.float32), k % 50)]
    got = vector_links.link_vectors(make(spark, rows), 0.93).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows, 0.93)


def test_links_with_a_radius_from_a_part_of_the_vectors(spark, monkeypatch):
    """The sample vouches for the recall, so not every cell is visited; no link reported is wrong."""
    monkeypatch.setattr(vector_links, "TRIAL_ROWS", 1500)
    monkeypatch.setattr(vector_links, "SAMPLE_ROWS", 800)
    rows = clusters(8, [3] * 900, dim=12)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.link_vectors(make(spark, rows), 0.93).collect()}
    expected = brute_links(rows, 0.93)
    assert all(got[i][0] <= n and got[i][1] >= root for i, (n, root) in expected.items())
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in expected.values())


def test_copies_count_as_vectors_and_meet_as_one(spark, monkeypatch):
    """Two thirds of the vectors are copies of two near ones; copies under another label are apart."""
    monkeypatch.setattr(vector_links, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    one = rng.normal(size=16)
    two, far = one + 0.02 * rng.normal(size=16), -one
    made = [(one, 0)] * 150 + [(two, 0)] * 120 + [(one, 1)] * 3 + [(far, 0)] * 2 + [(rng.normal(size=16), 0) for _ in range(120)]
    rows = [(i, v.astype(np.float32), label) for i, (v, label) in enumerate(made)]
    rng.shuffle(rows)
    got = vector_links.link_vectors(make(spark, rows), 0.93).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows, 0.93)


def test_links_of_odd_vectors(spark):
    unit = [1.0, 0, 0, 0]
    rows = [(1, unit, 1), (2, [2.0, 0, 0, 0], 1), (2, [2.0, 0, 0, 0], 1), (3, unit, 2), (4, unit, None), (5, None, 1), (6, [0, 0, 0, 0], 1)]
    rows += [(7, [1.0, None, 0, 0], 1), (8, [1.0, float("nan"), 0, 0], 1), (9, [1.0, float("inf"), 0, 0], 1), (10, [1.0], 1), (11, [], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links.link_vectors(make(spark, rows), 0.93).collect()}
    assert got.pop(1) == (1, 1, True) and got.pop(2) == (1, 1, False)
    assert got == {i: (0, i, True) for i in range(3, 12)}
    nothing = vector_links.link_vectors(make(spark, rows).where("false"), 0.93)
    assert nothing.columns == ["vec_id", "n_links", "component_id", "kept"] and nothing.count() == 0


def test_links_on_the_table(spark, data_dir):
    table = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    got = queries.op2_vector_links(spark, data_dir).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows, queries.LINK_COSINE)


def brute_nearest(rows, step, k):
    out = {}
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    for a in np.flatnonzero(ids % step == 0):
        score = np.array([np.sqrt(np.cumsum((x[a] - y) ** 2)[-1]) for y in x])
        order = [b for b in np.lexsort((ids, score)) if b != a][:k]
        out[int(ids[a])] = [(int(ids[b]), score[b]) for b in order]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sizes", [(16_384, 2_048, 256), (200, 16, 8)])
def test_nearest_equal_all_distances(spark, monkeypatch, sizes):
    """Also with a sample of a part of the vectors, and many blocks."""
    for name, value in zip(("SAMPLE_ROWS", "ENTRY_ROWS", "QUERY_ROWS"), sizes):
        monkeypatch.setattr(nearest, name, value)
    rows = clusters(2, [80, 40] + [2] * 200)
    got = by_query(nearest.nearest(make(spark, rows), F.col("vec_id") % 10 == 0, 10))
    assert got == brute_nearest(rows, 10, 10)


def test_nearest_with_ties_few_candidates_and_odd_vectors(spark):
    rows = [(i, [float(i % 3), 1.0], 1) for i in range(12)]
    assert by_query(nearest.nearest(make(spark, rows), F.col("vec_id") % 6 == 0, 5)) == brute_nearest(rows, 6, 5)
    odd = [(0, [1.0, 0], 1), (10, [0, 0], 1), (20, None, 1), (30, [1.0, None], 1), (40, [float("inf"), 1], 1), (3, [3.0, 0], 1), (3, [3.0, 0], 1)]
    assert by_query(nearest.nearest(make(spark, odd), F.col("vec_id") % 10 == 0, 5)) == {0: [(3, 2.0)]}
    assert nearest.nearest(make(spark, odd).where("false"), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_nearest_on_the_table(spark, data_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").collect()]
    assert by_query(queries.op7_nearest_vectors(spark, data_dir)) == brute_nearest(rows, 100, queries.NEIGHBOURS)
