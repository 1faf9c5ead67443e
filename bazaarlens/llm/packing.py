"""Vector bin packing of tokenised documents into training sequences."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.staging import staged

#: Pieces that one task packs together. Padding per group is about one open sequence.
GROUP_PIECES = 8192
#: Texts whose pieces make one batch, and characters that are taken apart at once.
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 256, 1 << 20
#: Words, and stretches between white space, whose ids a worker remembers, in each of two generations.
MEMORY_WORDS = 1 << 18

#: Fixed values of the tokenizer that :class:`WordIds` may take apart into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_END = "</w>"
#: The same words in texts of characters up to U+024F, which are their own normal form, without the
#: control characters that only Python counts as white space.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-\u024f"
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9²³¹¼-¾]|[^\s0-9²³¹¼-¾{_LETTERS}]+")
_PLAIN = re.compile("[^\x1c-\x1f\u0250-\U0010ffff]*")
_BLANK = re.compile(r"\s")
_IS_BLANK = np.array([chr(c).isspace() for c in range(0x250)])
#: A stretch is told apart inside a batch by a polynomial of its characters modulo 2^64.
_CHARACTER = np.random.default_rng(20_240_609).integers(1, 1 << 63, 0x250, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class WordIds:
    """Token ids of texts as the tokenizer gives them, with a memory of the ids of words.

    A tokenizer that splits texts into words first, and whose tokens mark the end of a
    word, gives a text the ids of its words in turn. No word reaches over white space, so
    many texts are cut there at once in numpy. Only the distinct stretches are looked up,
    only those not met before are cut into words, and only words not met before are
    encoded, together as one text whose ids are cut at word ends. Texts whose
    lower case has characters beyond U+024F, texts with what may be a special token, and all
    texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        parts = json.loads(self.model.to_str())
        steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        first = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_word = (
            steps == WORD_NORMALIZERS
            and first.get("pattern") == {"Regex": WORD_PATTERN}
            and (first.get("behavior"), first.get("invert")) == ("Removed", True)
            and parts["model"].get("end_of_word_suffix") == WORD_END
        )
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.powers = [np.zeros(0, np.uint64)] * 2

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn_words(self, words: list[str]) -> None:
        ids = self.whole(" ".join(words))
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) == len(words) and (not len(ids) or at[-1] == len(ids)):
            raw, cuts = ids.tobytes(), [0, *(at * 4).tolist()]
            self.memory.update((w, raw[a:b]) for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True))
        else:
            self.memory.update((w, self.whole(w).tobytes()) for w in words)

    def _unknown(self, words: Iterable[str]) -> list[str]:
        """The words without ids. Words of the older generation move to the younger, so frequent ones stay."""
        unknown = []
        for word in words:
            ids = self.older.get(word)
            if ids is None:
                unknown.append(word)
            else:
                self.memory[word] = ids
        return unknown

    def _learn(self, stretches: list[str]) -> None:
        """A stretch of letters is one word; others are put together from their words."""
        cut = {s: _WORD.findall(s) for s in stretches if not s.isalpha()}
        words = set().union(*cut.values()).difference(self.memory)
        words.update(s for s in stretches if s not in cut)
        words = self._unknown(words)
        if words:
            self._learn_words(words)
        get = self.memory.__getitem__
        self.memory.update([(s, b"".join(map(get, own))) for s, own in cut.items()])

    def _stretch_ids(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a plain text in lower case, and where its stretches start in the text and in the ids."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        edge = np.diff(np.concatenate(([True], _IS_BLANK[code], [True])).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(self.powers[0]) < len(code):
            self.powers = [_powers(base, len(code)) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
        through = _CHARACTER[code]
        through *= self.powers[0][: len(code)]
        np.cumsum(through, out=through)
        before = np.where(begin > 0, through[begin - 1], np.uint64(0)) if len(begin) else through[:0]
        hashes = (through[end - 1] - before) * self.powers[1][begin]
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        own = [text[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.memory) > MEMORY_WORDS:
            self.memory, self.older = {}, self.memory
        raw = list(map(self.memory.get, own))
        new = [k for k, ids in enumerate(raw) if ids is None]
        if new:
            unknown = self._unknown(own[k] for k in new)
            if unknown:
                self._learn(unknown)
            for k in new:
                raw[k] = self.memory[own[k]]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        start, n = np.cumsum(size) - size, size[which]
        at = np.cumsum(n) - n
        flat = np.frombuffer(b"".join(raw), "<u4")
        return flat[np.repeat(start[which] - at, n) + np.arange(n.sum())], begin, np.append(at, n.sum())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        low = [t.lower() for t in texts]
        plain = [self.by_word and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in low]
        out = [None if p else self.whole(t) for t, p in zip(texts, plain, strict=True)]
        for run in _runs([(i, len(low[i])) for i in np.flatnonzero(plain).tolist()]):
            own = [low[i] for i in run]
            if len(run) == 1 and len(own[0]) > CHARACTERS_AT_ONCE:
                out[run[0]] = np.concatenate([self._stretch_ids(part)[0] for part in _parts(own[0])])
                continue
            ids, begin, at = self._stretch_ids("\n".join(own))
            cuts = np.cumsum([0, *(len(t) + 1 for t in own)])
            cuts = at[np.searchsorted(begin, cuts)].tolist()
            for i, a, b in zip(run, cuts[:-1], cuts[1:], strict=True):
                out[i] = ids[a:b]
        return out


@functools.cache
def word_ids(path: str) -> WordIds:
    """One memory for all tasks of a Python worker."""
    return WordIds(path)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _runs(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Runs of texts (place, length) of bounded length together; a longer text is alone."""
    run, total = [], 0
    for i, size in sizes:
        if run and total + size > CHARACTERS_AT_ONCE:
            yield run
            run, total = [], 0
        run.append(i)
        total += size + 1
    if run:
        yield run


def _parts(text: str) -> Iterator[str]:
    """A long text cut at white space."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + CHARACTERS_AT_ONCE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _cut(tokenizer: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(public_tokenizers.path(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(part.column(0).to_pylist(), model.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        for c, v in zip(columns, (doc_id, start, len(piece), len(ids), piece.tobytes()), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "start", "length", "doc_tokens", "ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` (little-endian 32-bit ids as binary).

    Each document (doc_id, text) becomes its ids and ``end_id``, cut every ``capacity``
    ids. Null texts are empty; an empty text gives one piece with the end id alone.
    """
    return documents.select("doc_id", "text").mapInArrow(_cut(tokenizer, end_id, capacity), PIECES)


def dot_product_bins(demand: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and its offset (first dimension) there.

    ``demand`` (items x dimensions) must fit ``capacity`` item by item. Bins are filled
    one after another: among all items that fit what is left in every dimension, the one
    with the largest dot product of its demand with what is left, both in units of the
    capacity, goes in, until none fits. Ties go to the smaller demand, first dimension
    first, then to the item that comes first. Items of equal demand are taken from one
    stack, so a step costs the number of different demands and not the number of items.
    """
    n = len(demand)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    kinds, kind = np.unique(demand, axis=0, return_inverse=True)
    kind = kind.ravel()
    stacks = [s[::-1].tolist() for s in np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind, minlength=len(kinds)))[:-1])]
    scaled = kinds / capacity
    # The first item of a bin does not depend on the others, so it comes from one fixed order.
    starts = iter(np.argsort(-(scaled @ np.ones(len(capacity))), kind="stable").tolist())
    live = np.arange(len(kinds))  # kinds with items left, by their first dimension
    (tokens, *others), live_scaled, gone = kinds.T.copy(), scaled, np.zeros(len(live), bool)
    stale = 0
    k = next(starts, None)
    b = 0
    while k is not None:
        if not stacks[k]:
            k = next(starts, None)
            continue
        room, offset, fits, best = capacity.astype(np.int64).copy(), 0, len(live), k
        while True:
            item = stacks[best].pop()
            bins[item], offsets[item] = b, offset
            offset += int(kinds[best, 0])
            room -= kinds[best]
            if not stacks[best]:
                gone[np.searchsorted(live, best)] = True
                stale += 1
            if 4 * stale > len(live):
                live, stale = live[~gone], 0
                (tokens, *others), live_scaled, gone = kinds[live].T.copy(), scaled[live], np.zeros(len(live), bool)
                fits = len(live)
            fits = int(np.searchsorted(tokens[:fits], room[0], side="right"))
            if not fits:
                break
            score = live_scaled[:fits] @ (room / capacity)
            for needed, left in zip(others, room[1:], strict=True):
                score[needed[:fits] > left] = -1.0
            score[gone[:fits]] = -1.0
            at = int(score.argmax())
            if score[at] < 0:
                break
            best = int(live[at])
        b += 1
    return bins, offsets


def _pack(capacity: tuple[int, int, int]) -> Callable[[pa.Table], pa.Table]:
    limit = np.array(capacity, np.int64)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        length, loss = (rows.column(c).to_numpy() for c in ("length", "loss"))
        demand = np.stack([length, np.ones(len(length), np.int64), loss], axis=1).astype(np.int64)
        bins, offsets = dot_product_bins(demand, limit)
        group = rows.column("part").to_numpy().astype(np.int64)
        out = rows.drop_columns(["part"])
        return out.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return pack


def pack(pieces: DataFrame, tokens: int, segments: int, loss_tokens: int, seed: int = 0) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces (doc_id, start, length, loss and any others).

    No sequence holds more than ``tokens`` tokens, ``segments`` pieces or ``loss_tokens``
    loss-bearing tokens; a piece beyond a limit by itself is an error. Pieces are dealt by
    a hash of their row into groups of a fixed size, and each group is packed by the
    dot-product heuristic in one task, whatever share of the rows one document or source
    has. Row ids are written first, so a rerun of a task sees the same groups.
    """
    # Ids are numbers with empty high bytes, which zstd stores in much less room.
    table = staged(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces", "zstd")
    worst = table.agg(F.count(F.lit(1)), F.max("length"), F.max("loss")).first()
    if worst[0] and (worst[1] > tokens or worst[2] > loss_tokens or segments < 1):
        raise ValueError("a piece is larger than a sequence")
    groups = max(1, worst[0] // GROUP_PIECES)
    table = table.withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.drop("part").schema)
    packed = table.groupBy("part").applyInArrow(
        _pack((tokens, segments, loss_tokens)), f"{fields}, sequence_id long, offset long"
    )
    return packed.drop("row")


def sequences(packed: DataFrame, tokens: int, pad_id: int) -> DataFrame:
    """``sequence_id, input_ids, segments, position`` arrays of exactly ``tokens`` entries.

    ``packed`` needs the pieces' ``ids``. A sequence has at most the packed number of
    segments, so the gathered rows are bounded. Padding has segment 0.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ids, segment, position = np.full(tokens, pad_id, np.int64), np.zeros(tokens, np.int64), np.zeros(tokens, np.int64)
        for k, (at, piece) in enumerate(zip(rows["offset"], rows["ids"], strict=True), 1):
            part = np.frombuffer(piece, "<u4")
            ids[at : at + len(part)], segment[at : at + len(part)] = part, k
            position[at : at + len(part)] = np.arange(len(part))
        head = rows["sequence_id"].iloc[0]
        return pd.DataFrame({"sequence_id": [head], "input_ids": [ids], "segments": [segment], "position": [position]})

    schema = "sequence_id long, input_ids array<long>, segments array<long>, position array<long>"
    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(build, schema)
