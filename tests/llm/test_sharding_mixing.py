from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import mixing, queries, sharding


def test_hypergeometric_of_large_populations_has_its_mean_and_spread():
    rng = np.random.default_rng(1)
    good, bad, n = 2_000_000_000, 6_000_000_000, 1_000_000
    draws = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)])
    spread = np.sqrt(n * 0.25 * 0.75 * (1 - n / (good + bad)))
    assert abs(draws.mean() - n / 4) < 5 * spread / np.sqrt(4000)
    assert abs(draws.std() / spread - 1) < 0.06
    assert sharding.hypergeometric(rng, good, 0, 5) == 5 and sharding.hypergeometric(rng, 0, bad, 5) == 0


def test_matrix_rows_use_up_the_capacities():
    rng = np.random.default_rng(2)
    room = np.array([5, 0, 7, 8])
    rows = [sharding.draw_row(rng, room, n) for n in (3, 0, 10, 7)]
    assert [r.sum() for r in rows] == [3, 0, 10, 7] and np.sum(rows, axis=0).tolist() == [5, 0, 7, 8]


def slots(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.shard, []).append(r.slot)
    return {s: sorted(v) for s, v in out.items()}


@pytest.mark.parametrize("chunk_bits,group_bits", [(13, 10), (3, 0)])
def test_shards_are_exact_and_gapless(spark, monkeypatch, chunk_bits, group_bits):
    """Also with many chunks, groups and buckets."""
    monkeypatch.setattr(sharding, "CHUNK_BITS", chunk_bits)
    monkeypatch.setattr(sharding, "GROUP_BITS", group_bits)
    rows = spark.range(0, 1003, 1, 5).withColumn("shard", F.lit("own")).withColumn("slot", F.lit("own"))
    got = sharding.shuffle_into_shards(rows, 8)
    found = slots(got)
    assert sorted(len(v) for v in found.values()) == [125] * 5 + [126] * 3
    assert all(v == list(range(len(v))) for v in found.values())
    assert sorted(r.row.id for r in got.collect()) == list(range(1003))
    assert sorted(sharding.shuffle_into_shards(rows, 8).collect()) == sorted(got.collect())


def test_shuffle_is_uniform(spark):
    """Each of 6 rows lands in each of 6 places about equally often over many seeds."""
    places = Counter()
    rows = spark.range(0, 6, 1, 2)
    for seed in range(30):
        for r in sharding.shuffle_into_shards(rows, 2, seed).collect():
            places[(r.row.id, r.shard, r.slot)] += 1
    assert max(places.values()) <= 15 and len(places) >= 30


def test_shards_of_documents(spark, data_dir, make_documents, tmp_path):
    got = queries.op3_hypergeometric_shards(spark, data_dir)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sizes = [len(v) for v in slots(got).values()]
    assert max(sizes) - min(sizes) <= 1
    make_documents([(1, None), (2, ""), (3, "é"), (3, "é"), (None, "x")]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op3_hypergeometric_shards(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == [(0, 2), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert sharding.shuffle_into_shards(make_documents([(1, "a")]).limit(0), 8).count() == 0


def test_shards_carry_the_texts(spark, data_dir, documents, monkeypatch):
    """The query shuffles whole documents and takes its digest columns from what arrives."""
    seen = []
    shuffle = sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda rows, *a, **b: seen.append(shuffle(rows, *a, **b)) or seen[-1])
    got = {r.doc_id: (r.size, r.text_crc32) for r in queries.op3_hypergeometric_shards(spark, data_dir).collect()}
    texts = {r.doc_id: r.text for r in seen[0].select("row.doc_id", "row.text").collect()}
    assert texts == {r.doc_id: r.text for r in documents.collect()}
    assert got == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}


def brute_targets(sizes, weights, total, passes):
    """Reshares the excess until none is above."""
    full, out = set(), [0.0] * len(sizes)
    while True:
        rest = total - sum(passes * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        out = [passes * s if i in full else rest * w / weight for i, (s, w) in enumerate(zip(sizes, weights))]
        more = {i for i in range(len(sizes)) if i not in full and out[i] > passes * sizes[i]}
        if not more:
            return out
        full |= more


def test_targets_reshare_the_excess():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        sizes = rng.integers(1, 10_000, n).tolist()
        weights = [(3, 1, 2)[i % 3] for i in range(n)]
        got = mixing.targets(sizes, weights, 1.5 * sum(sizes), 2)
        assert got == pytest.approx(brute_targets(sizes, weights, 1.5 * sum(sizes), 2))
    assert mixing.targets([0, 0], [3, 1], 0, 2) == [0, 0] and mixing.targets([], [], 0, 2) == []


@pytest.mark.parametrize("block", [3, 512])
def test_mix_meets_its_targets(documents, block):
    got = mixing.taken_words(mixing.mix(documents, block=block)).join(documents.select("doc_id", "source"), "doc_id").toPandas()
    assert len(got) == documents.count() and (got["taken"] <= 2 * got["size"]).all()
    per = got.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per["own"]).all() and (abs(per["taken"] - per["target"]) <= 0.5).all()
    weights = [(3, 1, 2)[i % 3] for i in range(len(per))]
    assert per["target"].tolist() == pytest.approx(brute_targets(per["size"].tolist(), weights, 1.5 * per["size"].sum(), 2))


def test_slots_follow_the_targets_all_the_way(documents):
    """Any run of slots holds each source near its share, and a slot has one source."""
    got = mixing.mix(documents, block=16).where("slot IS NOT NULL").join(documents.select("doc_id", "source"), "doc_id").toPandas()
    assert (got.groupby("slot")["source"].nunique() == 1).all() and ((got["last"] - got["first"]) > 0).all()
    assert (got.groupby(["slot"]).apply(lambda d: (d["last"] - d["first"]).sum(), include_groups=False) <= 16).all()
    source = got.groupby("slot")["source"].first().sort_index()
    shares = source.value_counts(normalize=True)
    half = source[: len(source) // 2].value_counts(normalize=True)
    assert (abs(half - shares).fillna(0) < 0.02).all()
    again = mixing.mix(documents, block=16).where("slot IS NOT NULL").toPandas()
    columns = ["slot", "doc_id", "epoch", "first", "last"]
    assert again[columns].sort_values(columns).values.tolist() == got[columns].sort_values(columns).values.tolist()


def test_mix_of_odd_documents(make_documents):
    rows = [(1, None), (2, ""), (3, "  \t "), (4, "a b c d", None), (5, "a b", "b"), (5, "a b", "b"), (6, "x " * 40, "a"), (7, "é ü z", "\U0001f600")]
    docs = make_documents(rows)
    got = {}
    for r in mixing.taken_words(mixing.mix(docs, block=2)).collect():
        got.setdefault(r.doc_id, []).append((r.size, r.source_size, r.taken))
    assert got[1] == got[2] == got[3] == [(0, 40, 0)]
    assert [x[0] for x in got[5]] == [2, 2] and got[4][0][0] == 4 and got[7][0][:2] == (2, 2)
    assert sum(x[2] for v in got.values() for x in v) == 75 and all(x[2] <= 2 * x[0] for v in got.values() for x in v)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.taken_words(mixing.mix(make_documents([(1, None)]))).collect()[0].taken == 0


def test_mixed_documents_hold_the_words_taken(documents, make_documents):
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.mix(documents)).collect()}
    got = mixing.mixed_documents(documents)
    assert got.schema == documents.schema
    words = Counter()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in got.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text == texts[r.doc_id] or texts[r.doc_id].split()[: len(r.text.split())] == r.text.split()
    assert dict(words) == {k: v for k, v in taken.items() if v}


def test_mixing_keeps_documents_without_an_id_or_with_a_shared_one(make_documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (None, "g h"), (None, "i j k"), (2, None)]
    odd = make_documents(rows)
    taken = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.taken_words(mixing.mix(odd)).collect())
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    found = Counter((r.doc_id, len(r.text.split())) for r in got.collect())
    assert {doc for doc, _ in found} == {1, None} and sum(n * k for (_, n), k in found.items()) == sum(t[2] for t in taken) == 29
    # One source has no target below its size: every row comes at least once, equal rows each.
    texts = Counter(r.text for r in got.collect())
    assert texts["a b c d e f"] >= 2 and all(texts[t] >= 1 for _, t in rows if t)


def test_rows_of_a_mixed_partition_follow_the_schedule(spark, documents, tmp_path):
    mixing.mixed_documents(documents, block=16).write.parquet(str(tmp_path / "mixed"))
    first = mixing.mix(documents, block=16).where("slot is not null").groupBy("doc_id", "epoch").agg(F.min("slot").alias("slot"))
    slots = {}
    for r in first.collect():
        slots.setdefault(r.doc_id, []).append(r.slot)
    for file in (tmp_path / "mixed").glob("*.parquet"):
        seen, last = Counter(), -1
        for doc in pq.read_table(file).column("doc_id").to_pylist():
            last, before = sorted(slots[doc])[seen[doc]], last
            seen[doc] += 1
            assert last >= before  # a slot may hold the ends of several documents


def test_a_tiny_source_does_not_stretch_the_schedule(documents):
    """As many slots as blocks; what finds none comes at the end, and every rank exists once."""
    shares, blocks = [3e6, 2e6, 20.0, 1.0], [5860, 3907, 1, 1]
    got = mixing._schedule(documents, shares, blocks).toPandas()
    assert got["slot"].is_unique and len(got) <= sum(blocks) + 4 * 24
    for src, n in enumerate(blocks):
        ranks = sorted(got[got["src"] == src]["rank"])
        assert ranks == list(range(len(ranks))) and len(ranks) >= n
    big = got[(got["src"] == 0) & (got["slot"] < 1000)]
    assert abs(len(big) - 600) < 10
