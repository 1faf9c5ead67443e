"""Token counts from the frequencies of pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.staging import staged

#: Spaces and their written form in the vocabulary; a pre-token is a run of them and what follows.
PRE_TOKEN = re.compile("[ ▁]+[^ ▁]*")
PRE_TOKEN_SQL = "[ ▁]+[^ ▁]*"
#: The most frequent pre-tokens are sent to every task; this bounds their number, their characters in all and of one.
COMMON, COMMON_CHARS, WORD_CHARS = 1 << 18, 1 << 23, 1 << 16


def _sentencepiece(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


def check_model(model: str) -> None:
    """Raises unless counts add up over pre-tokens: no piece may hold a space behind another
    character (so no merge crosses a boundary), and spaces may not be trimmed."""
    sp = _sentencepiece(model)
    if any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("the vocabulary has pieces across pre-tokens")
    if len(sp.encode("a  b ")) <= len(sp.encode("a b")) or sp.encode("a") == sp.encode(" a"):
        raise ValueError("the model trims spaces or adds none in front")


def _pieces(sp, words: list[str]) -> list[int]:
    """Pieces of each pre-token. The model itself puts a space in front, so the first
    character stays off; a lone space, the end of a text, is one piece."""
    found = sp.encode([w[1:] for w in words], num_threads=1)
    return [len(f) if len(w) > 1 else 1 for w, f in zip(words, found, strict=True)]


def _count_pieces(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _sentencepiece(model)
        for batch in batches:
            pieces = pa.array(_pieces(sp, batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pieces, batch.column(1)], names=["word", "pieces", "n"])

    return run


def _sum_pieces(model: str, common) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text: bytes and pieces. Pre-tokens outside the table are encoded once in a batch, so
    what is remembered of them is never more than the texts of the batch hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _sentencepiece(model)
        table = dict(zip(*common.value, strict=True))
        for batch in batches:
            sizes, totals, rare = [], [], {}
            for text in batch.column(1).to_pylist():
                text = text or ""
                counts = Counter(PRE_TOKEN.findall(" " + text)) if text else Counter()
                new = [w for w in counts if w not in table and w not in rare]
                rare.update(zip(new, _pieces(sp, new), strict=True))
                sizes.append(len(text.encode()))
                totals.append(sum((table[w] if w in table else rare[w]) * n for w, n in counts.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def frequencies(documents: DataFrame) -> DataFrame:
    """``word, n``: every distinct pre-token of the corpus and its frequency."""
    text = F.when(F.col("text") != "", F.concat(F.lit(" "), F.col("text")))
    words = documents.select(F.explode(F.regexp_extract_all(text, F.lit(PRE_TOKEN_SQL), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _encoded(words: DataFrame, model: str) -> DataFrame:
    return words.select("word", "n").mapInArrow(_count_pieces(model), "word string, pieces long, n long")


def vocabulary(documents: DataFrame, model: str) -> DataFrame:
    """``word, pieces, n``: every distinct pre-token of the corpus, its number of pieces and its frequency."""
    return _encoded(frequencies(documents), model)


def _common(words: DataFrame) -> DataFrame:
    """The pre-tokens of the highest classes of frequency that together keep both bounds.

    A class spans a sixteenth of a doubling. One aggregate gives the size of each of the
    few classes; words are only filtered, so no task gathers or sorts them.
    """
    words = words.where(F.length("word") <= WORD_CHARS).withColumn("class", F.floor(F.log2("n") * 16))
    least, rows, chars = None, 0, 0
    sizes = words.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("word")).alias("chars"))
    for size in sizes.orderBy(F.desc("class")).collect():
        rows, chars = rows + size.rows, chars + size.chars
        if rows > COMMON or chars > COMMON_CHARS:
            break
        least = size["class"]
    return words.where(F.lit(False) if least is None else F.col("class") >= least)


def count_tokens(documents: DataFrame, model: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``documents`` (doc_id, text).

    A text's count is the sum over its pre-tokens, frequency times pieces. The pieces of the
    corpus's most frequent pre-tokens (at most ``COMMON`` with ``COMMON_CHARS`` characters in all,
    none longer than ``WORD_CHARS``, none that occurs once) are counted once and go to every task
    as a table of bounded size. All others are encoded where the text is, once in a batch of
    texts, which gives the same sum: pairs of text and rare pre-token, whose share grows with the
    corpus, are neither written nor shuffled. Token ids are never kept for a text.

    Null and empty texts have no tokens. Repeated rows are counted each.
    """
    check_model(model)
    repeated = staged(frequencies(documents).where("n > 1"), "pre-tokens")
    top = _encoded(_common(repeated), model).select("word", "pieces").toArrow()
    common = documents.sparkSession.sparkContext.broadcast((top.column(0).to_pylist(), top.column(1).to_pylist()))
    counts = documents.select("doc_id", "text").mapInArrow(
        _sum_pieces(model, common), "doc_id long, n_bytes long, n_tokens long"
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
