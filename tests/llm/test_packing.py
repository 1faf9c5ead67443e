from __future__ import annotations

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from bazaarlens.llm import packing, queries


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 20)), max_size=60), st.integers(1, 5))
def test_bins_hold_all_limits_and_every_item(items, segments):
    demand = np.array([(t, 1, min(t, loss)) for t, loss in items], np.int64).reshape(-1, 3)
    capacity = np.array([20, segments, 15])
    keep = demand[:, 2] <= 15
    demand = demand[keep]
    bins, offsets = packing.dot_product_bins(demand, capacity)
    for b in np.unique(bins):
        inside = np.flatnonzero(bins == b)
        assert (demand[inside].sum(0) <= capacity).all()
        order = inside[np.argsort(offsets[inside], kind="stable")]
        assert offsets[order].tolist() == (np.cumsum(demand[order, 0]) - demand[order, 0]).tolist()
    # No two bins could be one: the heuristic leaves a bin only when nothing left fits.
    totals = np.array([demand[bins == b].sum(0) for b in np.unique(bins)]).reshape(-1, 3)
    for i in range(len(totals) - 1):
        for item in demand[bins > i]:
            assert (totals[i] + item > capacity).any()


def test_dot_product_prefers_what_matches_the_room_left():
    """With few loss tokens left and many tokens, the long item with little loss goes first."""
    demand = np.array([[50, 1, 50], [60, 1, 5], [40, 1, 35]])
    bins, _ = packing.dot_product_bins(demand, np.array([100, 4, 60]))
    assert bins[0] != bins[1] or bins[1] == bins[2]
    assert len(set(bins.tolist())) == 2


@functools.cache
def word_ids(name):
    return packing.WordIds(public_tokenizers.path(name))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \t\n\x1c\x85\xa0'sStTrRelLdDmMvV09²¼ªµßÀéİŸſǅΣς…—’<|>#_-\"áź界🙂\u200b")), max_size=14), max_size=4))
def test_word_ids_equal_the_tokenizer(texts):
    words = word_ids(queries.PACK_TOKENIZER)
    assert words.by_word
    texts = [*texts, "<|endoftext|> end", ""]
    for text, ids in zip(texts, words.encode(texts)):
        assert ids.tolist() == words.model.encode(text, add_special_tokens=False).ids
    if len(words.memory) > 200:
        words.memory, words.older = {}, words.memory


def test_word_ids_of_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "CHARACTERS_AT_ONCE", 20)
    words = packing.WordIds(public_tokenizers.path(queries.PACK_TOKENIZER))
    texts = ["", "Short one", "it's a longer text, cut\n\nat white-space; " * 9, "x" * 50 + " y", " " * 45, "don't " * 3 + "\t", "界 not plain"]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert ids.tolist() == words.model.encode(text, add_special_tokens=False).ids


def test_word_ids_of_every_character_that_is_not_encoded_whole():
    """Also capitals whose small letters lie further up."""
    words = word_ids(queries.PACK_TOKENIZER)
    texts = [f"a{c}b {c}{c} x{c} {c}1" for c in map(chr, range(0x260))]
    for text, ids in zip(texts, words.encode(texts)):
        assert ids.tolist() == words.model.encode(text, add_special_tokens=False).ids, text


def plain_bins(demand, capacity):
    """The heuristic by a loop over all items."""
    left, bins, b = list(range(len(demand))), {}, 0
    while left:
        room = capacity.astype(float)
        while fits := [i for i in left if (demand[i] <= room).all()]:
            best = max(fits, key=lambda i: ((demand[i] / capacity) @ (room / capacity), *(-demand[i]).tolist(), -i))
            bins[best], room = b, room - demand[best]
            left.remove(best)
        b += 1
    return [bins[i] for i in range(len(demand))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 8)), max_size=40))
def test_bins_equal_a_plain_loop(items):
    """Capacities are powers of two, so that equal products are equal numbers."""
    demand = np.array([(t, 1, min(t, loss)) for t, loss in items], np.int64).reshape(-1, 3)
    capacity = np.array([16, 4, 8])
    bins, _ = packing.dot_product_bins(demand, capacity)
    totals = [sorted(map(tuple, demand[bins == b].tolist())) for b in np.unique(bins)]
    plain = np.array(plain_bins(demand, capacity), int)
    assert totals == [sorted(map(tuple, demand[plain == b].tolist())) for b in np.unique(plain)]


def test_pack_with_fewer_loss_tokens_than_tokens(spark):
    """Prompts bear no loss, so each of the three limits closes sequences."""
    rng = np.random.default_rng(2)
    rows = [(i, 0, int(n), int(rng.integers(0, min(n, 30) + 1))) for i, n in enumerate(rng.integers(1, 65, 400))]
    rows += [(1000 + i, 0, 1, 0) for i in range(60)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, start long, length long, loss long"), 64, 6, 32).toPandas()
    assert len(packed) == len(rows)
    sums = packed.groupby("sequence_id").agg(tokens=("length", "sum"), pieces=("length", "size"), loss=("loss", "sum"))
    assert sums.tokens.max() <= 64 and sums.pieces.max() <= 6 and sums.loss.max() <= 32
    # Without the loss limit fewer sequences would do.
    free = packing.pack(spark.createDataFrame(rows, "doc_id long, start long, length long, loss long"), 64, 6, 64).toPandas()
    assert free.sequence_id.nunique() < len(sums) and free.groupby("sequence_id").loss.sum().max() > 32
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 40, 33)], "doc_id long, start long, length long, loss long"), 64, 6, 32)


def test_other_tokenizers_encode_whole_texts():
    words = word_ids("byte_bpe_50k.json")
    text = "Two words, 2 lines\n and <|endoftext|> é界"
    assert not words.by_word and words.encode([text])[0].tolist() == words.model.encode(text, add_special_tokens=False).ids


def check(documents, packed, capacity=queries.SEQUENCE_TOKENS):
    model = Tokenizer.from_file(public_tokenizers.path(queries.PACK_TOKENIZER))
    rows = packed.toPandas()
    expected = {}
    for r in documents.select("doc_id", "text").collect():
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        expected.setdefault(r.doc_id, []).append(ids)
    for doc_id, own in rows.groupby("doc_id", dropna=False):
        ids = expected[None if np.isnan(doc_id) else int(doc_id)]
        assert own["length"].sum() == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for p in own.sort_values("start").itertuples():
                assert (p.start, p.doc_tokens) == (at, len(ids[0]))
                assert p.ids_crc32 == zlib.crc32(ids[0][at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids[0])
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        assert own["length"].sum() <= capacity
    return rows


def test_documents_are_packed_whole_with_little_padding(documents):
    rows = check(documents, queries.packed_documents(documents))
    assert rows["doc_id"].nunique() == documents.count()
    assert rows["length"].sum() / (queries.SEQUENCE_TOKENS * rows["sequence_id"].nunique()) > 0.95


def test_edge_cases(make_documents):
    long = "wort " * 30_000
    docs = make_documents([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "no id"), (4, long)])
    rows = check(docs, queries.packed_documents(docs))
    assert rows[rows["doc_id"] == 1][["start", "length", "doc_tokens"]].values.tolist() == [[0, 1, 1]]
    assert len(rows[rows["doc_id"] == 3]) == 2
    assert queries.packed_documents(docs.limit(0)).count() == 0


def test_sequences_restore_the_ids(documents):
    pieces = packing.token_pieces(documents, queries.PACK_TOKENIZER, 1, 128).withColumn("loss", F.col("length"))
    packed = packing.pack(pieces, 128, 8, 128)
    built = {r.sequence_id: r for r in packing.sequences(packed, 128, 0).collect()}
    for p in packed.collect():
        row = built[p.sequence_id]
        part = slice(p.offset, p.offset + p.length)
        assert row.input_ids[part] == np.frombuffer(p.ids, "<u4").tolist()
        assert row.position[part] == list(range(p.length)) and len(set(row.segments[part])) == 1
        assert len(row.input_ids) == 128


def test_a_piece_beyond_a_limit_is_an_error(spark):
    pieces = spark.createDataFrame([(1, 0, 5, 5)], "doc_id long, start long, length long, loss long")
    with pytest.raises(ValueError):
        packing.pack(pieces, 4, 1, 4)
