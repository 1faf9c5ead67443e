"""Language proportions of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.staging import hashed_fraction

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: The model: labelled texts per language that it is fitted to (expected number), length of n-grams, how many are kept.
FIT_TEXTS, GRAM, MAX_GRAMS, SMOOTHING = 2_000, 3, 1 << 17, 0.5
#: EM rounds; log-likelihood asked for each language more, in units of log(words).
ROUNDS, PENALTY = 12, 2.0
#: Words whose likelihoods a task remembers, and characters of texts solved together (a longer text alone).
MEMORY_WORDS, CHARS_AT_ONCE = 1 << 17, 1 << 20
PREDICTION = "lang_pred string, score double, langs array<string>, shares array<double>"


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def _words(text: str | None) -> Counter:
    """Words in lower case with their frequency; none unless the text has a letter."""
    found = Counter(WORD.findall((text or "").lower()))
    return found if any(c.isalpha() for w in found for c in w) else Counter()


@dataclass
class Model:
    """Log-probabilities of n-grams (rows; the last is for unseen ones) per language (columns)."""

    languages: list[str]
    grams: dict[str, int]
    logs: np.ndarray

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word per language."""
        unseen = len(self.grams)
        ids = [[self.grams.get(g, unseen) for g in _grams(w)] for w in words]
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        flat = np.fromiter((i for row in ids for i in row), np.int64)
        return np.add.reduceat(self.logs[flat], starts, axis=0)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(lang, Counter())
            for word, n in _words(text).items():
                for gram in _grams(word):
                    own[gram] += n
    for lang, own in counts.items():
        grams = list(own)
        columns = [pa.array([lang] * len(grams)), pa.array(grams, pa.string()), pa.array([own[g] for g in grams], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])


def fit(labelled: DataFrame, texts: int = FIT_TEXTS, seed: int = 0) -> Model:
    """Fits to about ``texts`` rows per language (lang, text), chosen by a hash of the text.

    The sample's size and the number of n-grams are bounded, so counts come to the driver.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = sorted((r.lang, r["count"]) for r in labelled.groupBy("lang").count().collect())
    if not sizes:
        return Model([], {}, np.zeros((1, 0)))
    chosen = F.lit(False)
    for lang, n in sizes:
        chosen = chosen | ((F.col("lang") == lang) & hashed_fraction(F.col("text"), texts / n, seed))
    counts = labelled.where(chosen).select("lang", "text").mapInArrow(_count_grams, "lang string, gram string, n long")
    counts = counts.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    top = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("each"))
    rows = top.orderBy(F.desc("all"), "gram").limit(MAX_GRAMS).collect()
    languages = [lang for lang, _ in sizes]
    column = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros((len(rows) + 1, len(languages)))
    for i, row in enumerate(rows):
        for x in row.each:
            table[i, column[x.lang]] = x.n
    table += SMOOTHING
    return Model(languages, {r.gram: i for i, r in enumerate(rows)}, np.log(table / table.sum(0)))


def _climb(p: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM: shares per document and the log-likelihood they reach. ``p`` are word likelihoods."""
    words = np.add.reduceat(n, starts)[:, None]
    for _ in range(rounds):
        r = p * share[doc]
        r *= (n / r.sum(1))[:, None]
        share = np.add.reduceat(r, starts, axis=0) / words
    return share, np.add.reduceat(n * np.log((p * share[doc]).sum(1)), starts)


def mixtures(logs: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the selected languages per document, and which are selected.

    ``logs`` (words x languages), ``n`` word frequencies, ``starts`` first word of each
    document. EM over all languages ranks them; then the sets of the 1, 2, ... largest are
    solved again. A document's set grows until one language more no longer raises the
    log-likelihood less the penalty.
    """
    n = n.astype(np.float64)
    sizes = np.diff(np.r_[starts, len(n)])
    doc = np.repeat(np.arange(len(starts)), sizes)
    p = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60.0))
    count = p.shape[1]
    share, _ = _climb(p, n, doc, starts, np.full((len(starts), count), 1 / count), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best, shares, sets = np.full(len(starts), -np.inf), share.copy(), np.zeros(share.shape, bool)
    live = np.arange(len(starts))  # the documents whose sets still grow, with their words
    for k in range(1, count + 1):
        inside = np.zeros((len(live), count), bool)
        np.put_along_axis(inside, order[live, :k], True, axis=1)
        begin = np.where(inside, np.maximum(share[live], 1e-3), 0)
        begin /= begin.sum(1, keepdims=True)
        own, value = _climb(p, n, doc, starts, begin, ROUNDS // 2 if k > 1 else 0)
        value -= PENALTY * (k - 1) * np.log1p(np.add.reduceat(n, starts))
        better = value > best[live]
        done = live[better]
        best[done], shares[done], sets[done] = value[better], own[better], inside[better]
        if not better.any():
            break
        if not better.all():
            keep = better[doc]
            p, n, sizes, live = p[keep], n[keep], sizes[better], done
            doc, starts = np.repeat(np.arange(len(live)), sizes), np.cumsum(sizes) - sizes
    return shares, sets


def _predict_texts(model: Model, texts: list[str | None], memory: dict[str, int], table: list[np.ndarray]) -> list[tuple]:
    counts = [_words(t) for t in texts]
    new = list({w for c in counts for w in c if w not in memory})
    if new:
        at = len(memory)
        memory.update(zip(new, range(at, at + len(new)), strict=True))
        table[0] = np.concatenate([table[0], model.likelihoods(new)])
    full = [i for i, c in enumerate(counts) if c]
    out: list[tuple] = [(UNDETERMINED, 0.0, [], [])] * len(texts)
    if full:
        ids = np.fromiter((memory[w] for i in full for w in counts[i]), np.int64)
        n = np.fromiter((k for i in full for k in counts[i].values()), np.int64)
        starts = np.cumsum([0, *(len(counts[i]) for i in full)])[:-1]
        shares, sets = mixtures(table[0][ids], n, starts)
        for i, share, inside in zip(full, shares, sets, strict=True):
            picked = sorted(np.flatnonzero(inside).tolist(), key=lambda k: (-share[k], k))
            names = [model.languages[k] for k in picked]
            out[i] = (names[0], float(min(1.0, share[picked[0]])), names, share[picked].tolist())
    return out


def _runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of bounded size together."""
    run: list[str | None] = []
    size = 0
    for text in texts:
        if run and size + len(text or "") > CHARS_AT_ONCE:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text or "") + 1
    if run:
        yield run


def predictor(spark, model: Model):
    """A column function: struct ``lang_pred, score, langs, shares`` of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        memory: dict[str, int] = {}
        table = [np.zeros((0, len(own.languages)))]
        names = ["lang_pred", "score", "langs", "shares"]
        for texts in batches:
            rows: list[tuple] = []
            for part in _runs([t if isinstance(t, str) else None for t in texts]):
                if len(memory) > MEMORY_WORDS:
                    memory, table = {}, [np.zeros((0, len(own.languages)))]
                if own.languages:
                    rows += _predict_texts(own, part, memory, table)
                else:
                    rows += [(UNDETERMINED, 0.0, [], [])] * len(part)
            yield pd.DataFrame(rows, columns=names)

    return predict


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may be fitted to: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, langs, shares`` for each row of ``documents`` (doc_id, text, lang).

    Languages are learned from rows that have a lang and are not held out. Predictions
    read the whole text and nothing else: the likelihoods of its words' n-grams, mixed by
    EM, give shares; ``langs`` is the set selected by penalised likelihood and
    ``lang_pred`` its largest member, ``score`` that member's share. Texts that are null
    or have no letter, and all texts if nothing could be learned, are ``und`` with score
    0. Ties go to the language first by code point. Repeated rows are predicted each.
    """
    model = fit(documents.where(~held_out()).select("lang", "text"), seed=seed)
    said = predictor(documents.sparkSession, model)
    found = documents.select("doc_id", held_out().alias("held_out"), said(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.*")


def known_language(documents: DataFrame, least: float = 0.0, seed: int = 0) -> DataFrame:
    """The rows of ``documents`` whose language is determined with at least the share ``least``. Columns stay."""
    model = fit(documents.where(~held_out()).select("lang", "text"), seed=seed)
    said = predictor(documents.sparkSession, model)(F.col("text"))
    return documents.where((said["lang_pred"] != UNDETERMINED) & (said["score"] >= least))
