"""Benchmark passages in documents, found by one Aho-Corasick automaton over item words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.staging import staged

WINDOW = 10
#: Windows of one automaton (at most ten nodes each); more windows make more automata.
AUTOMATON_WINDOWS = 100_000
#: Bytes of a text that are cut into words at once.
SLICE_BYTES = 1 << 20
#: Every byte that no word holds becomes a space; A-Z become a-z. Bytes from 128 on belong to words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: Stands for a word that no window holds.
_OTHER = "\0"


def words(data: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return data.translate(_WORDS).split()


def _slices(data: bytes) -> Iterator[bytes]:
    """Normalised parts of a text, cut between words."""
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        part = data[at:end].translate(_WORDS)
        while end < len(data) and b" " not in part:  # one word longer than a slice
            part += data[end : end + SLICE_BYTES].translate(_WORDS)
            end += SLICE_BYTES
        if end < len(data):
            part = part[: part.rfind(b" ") + 1]
        yield part
        at += len(part)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, found = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = words((text or "").encode())
            for at in range(max(1, len(own) - WINDOW + 1) if own else 0):
                items.append(item)
                found.append(b" ".join(own[at : at + WINDOW]))
        yield pa.RecordBatch.from_arrays([pa.array(items, batch.column(0).type), pa.array(found, pa.binary())], names=["item_id", "window"])


class Windows:
    """The automaton. Each distinct word of its windows is one symbol, so that a window is a string of at
    most ten symbols and a document is a string with one symbol per word."""

    def __init__(self, windows: list[bytes]):
        self.symbol: dict[bytes, str] = {}
        self.length = np.empty(len(windows), np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, window in enumerate(windows):
            own = window.split(b" ")
            self.length[k] = len(own)
            self.automaton.add_word("".join(map(self._symbol, own)), k)
        self.automaton.make_automaton()

    def _symbol(self, word: bytes) -> str:
        at = len(self.symbol) + 1
        return self.symbol.setdefault(word, chr(at if at < 0xD800 else at + 0x800))

    def find(self, data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words, and for each occurrence its window and the place of its last word."""
        get = self.symbol.get
        text = "".join("".join(map(get, part.split(), repeat(_OTHER))) for part in _slices(data))
        found = np.array(list(self.automaton.iter(text)) if len(self.length) else [], np.int64).reshape(-1, 2)
        return len(text), found[:, 1], found[:, 0]


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of places covered by closed intervals; intervals that only touch join."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    start = np.flatnonzero(np.r_[True, first[1:] > reach[:-1] + 1])
    return first[start], reach[np.r_[start[1:] - 1, len(reach) - 1]]


def _offsets(data: bytes, places: np.ndarray, ends: bool) -> list[int]:
    """Code point offsets of the start (or end) of the words at ascending ``places``."""
    out, before, chars, at = [], 0, 0, 0
    todo = iter(places.tolist())
    want = next(todo, None)
    for part in _slices(data):
        if want is None:
            break
        flat = np.frombuffer(part, np.uint8) != 32
        edge = np.diff(np.r_[False, flat, False].astype(np.int8))
        cut = np.flatnonzero(edge == (-1 if ends else 1))
        raw = np.frombuffer(data, np.uint8, len(part), at)
        through = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        while want is not None and want < before + len(cut):
            out.append(chars + int(through[cut[want - before]]))
            want = next(todo, None)
        before, chars, at = before + len(cut), chars + int(through[-1]), at + len(part)
    return out


def _scan(shared, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``row, n_words, spans, items`` for each text: runs of hit words (first and last word, start and end
    offset in the text) and the items whose windows occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, owners = shared.value
        index = Windows(windows)
        span = pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "stop")])
        types = [pa.int64(), pa.int64(), pa.list_(span), pa.list_(kind)]
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                n, which, last = index.find(data)
                spans, items = [], set()
                if len(which):
                    begin, end = _runs(last - index.length[which] + 1, last)
                    starts, stops = _offsets(data, begin, False), _offsets(data, end, True)
                    names = ("first", "last", "start", "stop")
                    spans = [dict(zip(names, s, strict=True)) for s in zip(begin.tolist(), end.tolist(), starts, stops, strict=True)]
                    for k in np.unique(which).tolist():
                        items.update(owners[k])
                for c, v in zip(columns, (row.as_py(), n, spans, sorted(items)), strict=True):
                    c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "spans", "items"])

    return run


def _joined_spans(spans):
    """Runs covered by any of the spans of a list of lists, in order; words of both count once."""

    def add(done, s):
        top = F.element_at(done, -1)
        more = F.struct(
            top["first"].alias("first"),
            F.greatest(top["last"], s["last"]).alias("last"),
            top["start"].alias("start"),
            F.greatest(top["stop"], s["stop"]).alias("stop"),
        )
        meets = (F.size(done) > 0) & (s["first"] <= top["last"] + 1)
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(more))).otherwise(
            F.concat(done, F.array(s))
        )

    kind = "array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>"
    return F.aggregate(F.array_sort(F.flatten(spans)), F.array().cast(kind), add)


def find_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, spans, items`` for each row of ``documents`` (doc_id, text).

    ``items`` has item_id and text. Words are runs of digits, letters and characters beyond
    ASCII, with A-Z in lower case. A window is ten words in a row of an item, or all words
    of an item with fewer. ``spans`` are the runs of document words that lie inside an
    occurrence of a window: first and last word (from 0), and start and end offset in
    characters of the original text. ``items`` are the ids of items with an occurring
    window, each once, sorted.

    The distinct windows make one automaton that each task builds from a broadcast of at most
    ``AUTOMATON_WINDOWS`` pairs of window and item, and every whole text is scanned once by
    it, without a shuffle. More windows are dealt by a hash into several automata of about
    that size, each of which scans the texts in turn; spans and items of a row are then put
    together.

    Null texts have no words; so do items without words. Rows with an equal doc_id stay
    apart; items that share an id or a text all count. Windows of items without an id hit
    words, but such items are not listed. Other columns are not read.
    """
    spark = documents.sparkSession
    kind = items.schema["item_id"].dataType
    cut = T.StructType([T.StructField("item_id", kind), T.StructField("window", T.BinaryType())])
    windows = staged(items.select("item_id", "text").mapInArrow(_windows, cut).groupBy("window").agg(F.collect_set("item_id").alias("owners")), "windows")
    held = windows.agg(F.sum(F.greatest(F.size("owners"), F.lit(1)))).first()[0] or 0
    parts = max(1, -(-held // AUTOMATON_WINDOWS))
    schema = "row long, n_words long, spans array<struct<first:long,last:long,start:long,stop:long>>, items array<%s>" % kind.simpleString()
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()

    def scanned(texts: DataFrame, part: int) -> DataFrame:
        own = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        rows = own.orderBy("window").toArrow()
        shared = spark.sparkContext.broadcast((rows.column("window").to_pylist(), rows.column("owners").to_pylist()))
        if parts == 1:
            return texts.mapInArrow(_scan(shared, arrow), schema)
        found = staged(texts.mapInArrow(_scan(shared, arrow), schema), "item-spans")
        shared.unpersist()
        return found

    if parts == 1:
        return scanned(documents.select(F.col("doc_id").cast("long").alias("row"), "text"), 0).withColumnRenamed("row", "doc_id")
    texts = staged(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
    found = reduce(DataFrame.union, [scanned(texts.select("row", "text"), part) for part in range(parts)])
    merged = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        _joined_spans(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return texts.select("row", "doc_id").join(merged, "row").drop("row")


def contamination(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from :func:`find_items`."""
    found = find_items(documents, items)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
