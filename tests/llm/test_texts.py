from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from bazaarlens.llm import components, language, prob_minhash, queries, tokens

MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.COUNT_MODEL))


def check_counts(docs, got):
    expected = collections.Counter((r.doc_id, len((r.text or "").encode()), len(MODEL.encode(r.text or ""))) for r in docs.collect())
    rows = got.collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == expected
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" ▁ab</s>é\n\t界​🙂　")), max_size=30))
def test_pieces_add_up_over_pre_tokens(text):
    words = tokens.PRE_TOKEN.findall(" " + text) if text else []
    assert "".join(words) == (" " + text if text else "")
    assert sum(len(MODEL.encode(w[1:])) if len(w) > 1 else 1 for w in words) == len(MODEL.encode(text))


@pytest.mark.parametrize("common", [1 << 18, 5])
def test_counts_equal_the_library_on_the_table(documents, monkeypatch, common):
    """Also when nearly all pre-tokens come by the join."""
    monkeypatch.setattr(tokens, "COMMON", common)
    check_counts(documents, tokens.count_tokens(documents, queries.COUNT_MODEL, 100))


def test_counts_of_odd_texts(make_documents):
    texts = [None, "", " ", "  ", "a ", " a", "a  b ", "\n", "a\n b", "▁", "</s> <unk> <s>", "界🙂", "\x00", "x" * 20_000, "w " * 50_000]
    docs = make_documents([(i, t) for i, t in enumerate(texts)] + [(4, "a "), (None, "z")])
    check_counts(docs, tokens.count_tokens(docs, queries.COUNT_MODEL, 100))
    assert tokens.count_tokens(docs.limit(0), queries.COUNT_MODEL, 100).count() == 0


def test_rare_pre_tokens_are_counted_where_the_text_is(make_documents):
    """No pair of text and pre-token is shuffled, whatever share of the pre-tokens occurs once."""
    docs = make_documents([(i, f"once{i} twice{i // 2} ever {'long' * i}") for i in range(300)])
    got = tokens.count_tokens(docs, queries.COUNT_MODEL, 100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    check_counts(docs, got)


@pytest.mark.parametrize("bounds", [(1 << 18, 1 << 23), (40, 1 << 23), (1 << 18, 300), (0, 0)])
def test_counts_whatever_is_sent_to_every_task(spark, documents, monkeypatch, bounds):
    """Also a long pre-token that many texts share; what is chosen keeps both bounds."""
    monkeypatch.setattr(tokens, "COMMON", bounds[0])
    monkeypatch.setattr(tokens, "COMMON_CHARS", bounds[1])
    shared = "x" * 300
    docs = documents.select("doc_id", F.concat("text", F.lit(" " + shared)).alias("text"))
    check_counts(docs, tokens.count_tokens(docs, queries.COUNT_MODEL, 100))
    words = tokens.vocabulary(docs, queries.COUNT_MODEL)
    chosen = tokens._common(words).select("word", "n").toPandas()
    assert len(chosen) <= bounds[0] and chosen["word"].str.len().sum() <= bounds[1]
    if bounds == (1 << 18, 1 << 23):
        assert " " + shared in set(chosen["word"])
    if 0 < bounds[0] < 100:
        rest = words.join(spark.createDataFrame(chosen[["word"]]), "word", "left_anti").agg(F.max("n")).first()[0]
        assert 0 < len(chosen) and rest <= chosen["n"].min()



def test_components_equal_union_find(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (40, 30), (200, 150), (300, 2000)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (None, 1)]
        root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a in root and b in root:
                one, two = sorted((find(a), find(b)))
                root[two] = one
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
        assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def shingle_set(text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in (text or "").lower()).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    holders = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    shared = collections.Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            one, two = sorted((find(a), find(b)))
            root[two] = one
    return {i: find(i) for i in ids}


def edited(rng, words, share):
    return " ".join(rng.choice("qwxyz") * 7 if rng.random() < share else w for w in words)


def groups(seed, sizes):
    """Near copies of one text each, edited at rates around the threshold, beside unrelated texts."""
    rng, rows = random.Random(seed), []
    for size in sizes:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(size):
            rows.append(edited(rng, words, rng.choice([0, 0.01, 0.02, 0.04, 0.08])))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_shingles_equal_plain_sets():
    rng = random.Random(0)
    texts = ["", " \n ", "One", "one two", "a b c d", "a b c d e", "A  b\tc\nd e f", "é 界 " * 9, "x y " * 500, " a b"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(50)]
    doc, element, times = prob_minhash.shingles(texts)
    for k, text in enumerate(texts):
        assert (doc == k).sum() == len(shingle_set(text))
    words = [len([w for w in t.split() if w]) for t in texts[:-51]]
    assert [times[doc == k].sum() for k in range(len(words))] == [max(min(n, 1), n - 4) for n in words]
    one, two = (set(element[doc == k]) for k in (5, 6))
    assert one < two


def test_registers_agree_with_probability_jaccard():
    """The share of equal registers estimates the weighted similarity within sampling error."""
    rng = np.random.default_rng(5)
    for _ in range(4):
        shared, own = 60, 15
        ids = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
        a, b = ids[: shared + own], np.r_[ids[:shared], ids[shared + own :]]
        wa, wb = 1 + rng.integers(0, 3, len(a)), 1 + rng.integers(0, 3, len(b))
        exact = sum(1 / (np.maximum(wa / wa[i], np.r_[wb[:shared], np.zeros(own)] / wb[i]).sum() + (wb[shared:] / wb[i]).sum()) for i in range(shared))
        found = prob_minhash.signatures(np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b], np.r_[wa, wb].astype(float), 2)
        share = (found[0] == found[1]).mean()
        assert abs(share - exact) < 4 * math.sqrt(exact * (1 - exact) / prob_minhash.REGISTERS)


def test_sketches_count_different_registers(spark):
    rng = np.random.default_rng(8)
    one = rng.integers(0, 1 << 63, (50, prob_minhash.REGISTERS), dtype=np.uint64)
    two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 1 << 63, one.shape, dtype=np.uint64))
    exact = ((prob_minhash._mixed(one) ^ prob_minhash._mixed(two)) & np.uint64((1 << prob_minhash.SKETCH_BITS) - 1) != 0).sum(1)
    lists = [prob_minhash.sketches(x).view(np.int64).tolist() for x in (one, two)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(*lists))], "i int, x array<long>, y array<long>")
    got = df.select("i", prob_minhash.different_registers("x", "y").alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == exact.tolist() and exact.max() <= prob_minhash.MOST_DIFFERENT


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_all_pairs(make_documents, seed):
    rows = groups(seed, [60, 25, 10] + [2] * 15 + [1] * 30)
    got = prob_minhash.near_duplicates(make_documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_on_the_table(spark, data_dir, documents):
    got = queries.op9_prob_minhash(spark, data_dir).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components([(r.doc_id, r.text) for r in documents.collect()])


def test_no_similar_pair_is_left_out_by_parities(spark):
    """Pairs just at the threshold stay whatever their size; most small dissimilar ones go."""
    rng, rows = np.random.default_rng(10), []
    for n in [*range(1, 60), 90, 450, 4500, 45_000]:
        for common in (math.ceil(8 * n / 9), n // 2):
            ids = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            both = np.r_[ids[:n], ids[:common], ids[n:]]
            one, two = prob_minhash.parities(np.repeat([0, 1], n), both, 2).view(np.int64).tolist()
            rows.append((n, one, n, two, common / (2 * n - common) >= 0.8))
    df = spark.createDataFrame(rows, "n int, p array<long>, m int, q array<long>, similar boolean")
    got = df.select("n", "similar", prob_minhash.may_be_similar("n", "p", "m", "q").alias("stays")).collect()
    assert all(r.stays for r in got if r.similar)
    assert sum(not r.stays for r in got if not r.similar) > 50


def test_pairs_that_the_estimate_drops_are_verified(spark):
    """Among 8,000 pairs at 0.8 some differ in more registers than the estimate allows; none is left out."""
    rng, dropped = np.random.default_rng(12), []
    for _ in range(80):
        ids = rng.integers(0, 1 << 63, (100, 10), dtype=np.uint64)
        sets = np.stack([ids[:, :9], np.c_[ids[:, :8], ids[:, 9]]], axis=1).ravel()
        doc = np.repeat(np.arange(200), 9)
        mixed = prob_minhash._mixed(prob_minhash.signatures(doc, sets, np.ones(len(doc)), 200)) & np.uint64(15)
        bits = prob_minhash.parities(doc, sets, 200).view(np.int64)
        for k in np.flatnonzero((mixed[::2] != mixed[1::2]).sum(1) > prob_minhash.MOST_DIFFERENT):
            dropped.append((9, bits[2 * k].tolist(), bits[2 * k + 1].tolist()))
    assert dropped
    df = spark.createDataFrame(dropped, "n int, p array<long>, q array<long>")
    assert df.where(prob_minhash.may_be_similar("n", "p", "n", "q")).count() == len(dropped)


def test_copies_that_repeat_a_passage_unequally_often(make_documents):
    """Search follows the set similarity: a passage once in one copy and 100 times in the other."""
    rng, rows = random.Random(9), []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(140)]
        for times in (1, 100):
            rows.append((len(rows), " ".join(words[:100] + words[100:] * times)))
    expected = brute_components(rows)
    assert all(expected[i] == i - i % 2 for i, _ in rows)
    got = prob_minhash.near_duplicates(make_documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def test_near_duplicates_of_odd_texts(make_documents):
    long = "lang wort text satz ende " * 4000
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (5, "A b"), (6, "a  B"), (7, "a b c"), (8, long), (9, long + " x"), (10, "d e f g h"), (10, "d e f g h"), (None, "a b")]
    docs = make_documents(rows)
    got = prob_minhash.near_duplicates(docs)
    found = {(r.doc_id, r.component_id, r.kept) for r in got.collect()}
    assert got.count() == len(rows)
    expected = {(i, i, True) for i in (1, 2, 3, 4, 5, 7, 8, 10)} | {(6, 5, False), (9, 8, False), (None, None, True)}
    assert found == expected
    kept = prob_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 10]
    assert prob_minhash.near_duplicates(docs.limit(0)).count() == 0 == prob_minhash.one_of_each(docs.limit(0)).count()


def test_languages_of_held_out_documents(spark, data_dir, documents):
    got = queries.op10_language_mixture(spark, data_dir).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]] == got["held_out"].tolist()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.97
    assert got["score"].between(0, 1).all() and len(got) == documents.count()
    assert all(abs(sum(s) - 1) < 1e-6 for s in got["shares"])


def test_held_out_labels_change_nothing(documents):
    other = documents.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(language.identify(d).collect(), key=lambda r: r.doc_id) for d in (documents, other))
    assert a == b


def test_mixtures_are_recovered(documents):
    """Texts glued from two languages show both, in about their share of words; one language stays alone."""
    model = language.fit(documents.select("lang", "text"))
    by = collections.defaultdict(list)
    for r in documents.collect():
        by[r.lang] += r.text.split()
    memory, table = {}, [np.zeros((0, len(model.languages)))]
    for share in (0.3, 0.5, 0.8, 1.0):
        n = 300
        text = " ".join(by["de"][: int(n * share)] + by["es"][: n - int(n * share)])
        ((pred, score, langs, shares),) = language._predict_texts(model, [text], memory, table)
        assert set(langs) == ({"de", "es"} if share < 1 else {"de"})
        assert dict(zip(langs, shares))["de"] == pytest.approx(share, abs=0.12)
        assert pred == ("es" if share < 0.5 else "de") or share == 0.5
        assert score == max(shares)


def test_em_never_lowers_the_likelihood():
    rng = np.random.default_rng(6)
    p = rng.random((40, 3))
    n = rng.integers(1, 5, 40).astype(float)
    doc, starts = np.repeat([0, 1], [15, 25]), np.array([0, 15])
    values = [language._climb(p, n, doc, starts, np.full((2, 3), 1 / 3), k)[1] for k in range(8)]
    assert (np.diff(values, axis=0) >= -1e-9).all()


def test_language_sets_grow_as_long_as_it_pays():
    """A text with equal parts of five languages shows all five; with one or two it shows those."""
    logs = np.full((60, 6), -12.0)
    logs[np.arange(60), np.arange(60) % 6] = -2.0
    texts = [[w for w in range(60) if w % 6 in langs] for langs in ((0, 1, 2, 3, 4), (2,), (1, 5), range(6))]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    shares, sets = language.mixtures(logs[np.concatenate(texts)], np.full(sum(map(len, texts)), 5), starts)
    assert [np.flatnonzero(s).tolist() for s in sets] == [[0, 1, 2, 3, 4], [2], [1, 5], [0, 1, 2, 3, 4, 5]]
    assert shares[0, :5] == pytest.approx([0.2] * 5, abs=0.01) and shares[1, 2] == pytest.approx(1)


def test_languages_of_odd_texts(make_documents):
    rows = [(1, None), (2, ""), (3, "123 ²³ !!"), (4, "der die das und ist nicht"), (4, "der die das und ist nicht"), (None, "the of and to"), (6, "界"), (7, "wort " * 50_000)]
    docs = make_documents(rows).withColumn("lang", F.when(F.col("doc_id") == 4, "de").when(F.col("doc_id").isNull(), "en"))
    got = {}
    for r in language.identify(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all((got[i][0].lang_pred, got[i][0].score) == ("und", 0.0) for i in (1, 2, 3))
    assert len(got[4]) == 2 and {r.lang_pred for r in got[4]} <= {"de", "en"}
    assert all(r.held_out is False for r in got[None])
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    kept = language.known_language(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 6, 7]
    assert language.identify(docs.limit(0)).count() == 0
