from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from bazaarlens.llm import mixing, packing, queries
from bazaarlens.llm.staging import staged
from test_packing import check
from test_texts import brute_components


@pytest.fixture(scope="module")
def results(spark, data_dir, documents):
    docs, out = documents, [documents]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, data_dir), "test-stage")
        out.append(docs)
    return out


def test_stages_keep_columns_and_do_their_work(results):
    raw, known, unique, mixed, packed = results
    assert known.schema == unique.schema == mixed.schema == raw.schema
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in raw.collect() if any(c.isalpha() for c in r.text)}
    groups = brute_components([(r.doc_id, r.text) for r in known.collect()])
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(groups.values()))
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.mix(unique)).collect() if r.taken}
    assert dict(words) == taken
    check(mixed, packed, queries.SEQUENCE_TOKENS)


def test_packed_rows_build_the_sequences(results):
    """The last stage's rows hold the ids whose digest they give, and build whole sequences."""
    rows = results[-1].collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    built = {r.sequence_id: r.input_ids for r in packing.sequences(results[-1], queries.SEQUENCE_TOKENS, 0).collect()}
    for r in rows:
        assert built[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()


def test_run_gives_the_same_rows(spark, data_dir, results):
    ran = corpus_pipeline.run(spark, data_dir)
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(ran.select(columns).collect()) == sorted(results[-1].select(columns).collect())


def test_stages_survive_odd_and_empty_tables(spark, data_dir, make_documents):
    for docs in (make_documents([(1, None), (2, ""), (3, "12"), (None, "ein wort"), (4, "ein wort mehr"), (4, "ein wort mehr")]), make_documents([(1, "a")]).limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = staged(stage(spark, docs, data_dir), "test-odd")
            assert k == 3 or docs.columns == columns
        ids = {r.doc_id for r in docs.collect()}
        assert ids in (set(), {None, 4})  # a document without an id reaches the sequences
