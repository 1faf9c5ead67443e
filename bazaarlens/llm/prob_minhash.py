"""Near-duplicate documents by ProbMinHash signatures, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.components import connected_components
from bazaarlens.llm.staging import staged

WORDS, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares a band with probability 1 - (1 - 0.8^7)^32 > 0.999.
BANDS, BAND_ROWS = 32, 7
REGISTERS = BANDS * BAND_ROWS
#: Parities of the shingles in this many classes bound a pair's similarity from above.
PARITY_WORDS = 16
#: An estimate by four bits of each register; near_duplicates drops no pair by it. At similarity 0.8 more
#: than MOST_DIFFERENT of 224 registers differ with probability 2.3e-4.
SKETCH_BITS, MOST_DIFFERENT = 4, 63
WORD_BITS = 56
SKETCH_WORDS = REGISTERS // WORD_BITS
BYTES_AT_ONCE = 1 << 19
SIGNATURES = "doc_id long, f1 long, f2 long, n int, bands array<long>, parity array<long>"

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, max(WORDS, BAND_ROWS) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of bytes other than white space (9 to 13 and 32).

    A word's hash is a polynomial in its bytes modulo 2^64, from differences of one
    cumulative sum; the base is odd, so dividing by its power is a multiplication.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)]
    back = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    return starts, _mixed((sums[ends] - sums[starts]) * back[starts])


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, hash, multiplicity`` of the distinct word shingles of each text, sorted by doc and hash.

    Words are separated by white space and compared in lower case. A text with fewer than
    five words has one shingle of all its words; a text without words has none.
    """
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    starts, words = _word_hashes(data)
    doc = np.searchsorted(bounds, starts, side="right")
    count = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(count) - count
    sizes = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(raw)), sizes)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.r_[words, np.zeros(WORDS, np.uint64)]
    inside = np.minimum(count, WORDS)[owner]
    total = np.zeros(len(owner), np.uint64)
    for k in range(WORDS):
        total += np.where(k < inside, padded[at + k] * _PLACE[k], np.uint64(0))
    hashes = _mixed(total + inside.astype(np.uint64) * _PLACE[WORDS])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])][: len(owner)])
    return owner[fresh], hashes[fresh], np.diff(np.r_[fresh, len(owner)])


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """ProbMinHash registers (docs x registers): the element whose arrival came first.

    Each element arrives as a Poisson process whose rate is its weight, at times and
    registers drawn from its hash; a register keeps the earliest arrival. Two documents
    agree in a register with their probability Jaccard similarity. An element's process
    ends once it is later than all registers of its document; processes advance together,
    one arrival per round.
    """
    time = np.full(docs * REGISTERS, np.inf)
    winner = np.zeros(docs * REGISTERS, np.uint64)
    live, now, step = np.arange(len(element)), np.zeros(len(element)), 0
    while len(live):
        step += 1
        draw = _mixed(element[live] + np.uint64(step * _BASE & (1 << 64) - 1))
        now[live] += -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        place = doc[live] * REGISTERS + (_mixed(draw) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(time, place, now[live])
        hit = time[place] == now[live]
        winner[place[hit]] = element[live[hit]]
        open_, back = np.unique(doc[live], return_inverse=True)
        latest = time.reshape(docs, REGISTERS)[open_].max(1)
        live = live[now[live] < latest[back]]
    return winner.reshape(docs, REGISTERS)


def sketches(registers: np.ndarray) -> np.ndarray:
    """Bit planes of the registers, packed into words (docs x planes * words)."""
    mixed = _mixed(registers).reshape(len(registers), 1, SKETCH_WORDS, WORD_BITS)
    planes = (mixed >> np.arange(SKETCH_BITS, dtype=np.uint64)[None, :, None, None]) & np.uint64(1)
    words = (planes << np.arange(WORD_BITS, dtype=np.uint64)).sum(3, dtype=np.uint64)
    return words.reshape(len(registers), SKETCH_BITS * SKETCH_WORDS)


def different_registers(x: str, y: str) -> Column:
    """Registers whose sketch bits differ, from two sketch columns."""
    total = F.lit(0)
    for w in range(SKETCH_WORDS):
        differ = None
        for plane in range(SKETCH_BITS):
            bits = F.col(x)[plane * SKETCH_WORDS + w].bitwiseXOR(F.col(y)[plane * SKETCH_WORDS + w])
            differ = bits if differ is None else differ.bitwiseOR(bits)
        total = total + F.bit_count(differ)
    return total


def parities(doc: np.ndarray, element: np.ndarray, docs: int) -> np.ndarray:
    """Whether each of 64 * PARITY_WORDS classes holds an odd number of a set's elements (docs x words).

    A class whose parity differs between two sets holds an element that only one of them has.
    """
    classes = 64 * PARITY_WORDS
    place = doc * classes + (_mixed(element + np.uint64(_BASE)) % np.uint64(classes)).astype(np.int64)
    odd = (np.bincount(place, minlength=docs * classes) & 1).astype(np.uint64).reshape(docs, PARITY_WORDS, 64)
    return (odd << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)


def may_be_similar(n: str, parity: str, other_n: str, other_parity: str) -> Column:
    """False only for sets that cannot reach the similarity, by their sizes and parities.

    With d elements in only one of the sets, the similarity is (n + m - d) / (n + m + d), and
    d is at least the number of parities that differ.
    """
    n, m = F.col(n), F.col(other_n)
    differ = F.lit(0)
    for w in range(PARITY_WORDS):
        differ = differ + F.bit_count(F.col(parity)[w].bitwiseXOR(F.col(other_parity)[w]))
    sizes = F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-6
    return sizes & (differ * (1 + SIMILARITY) <= (n + m) * (1 - SIMILARITY) + 1e-6)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), _signed(rows.ravel()))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size together; a longer text is alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BYTES_AT_ONCE:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if len(texts) > begin:
        yield begin, len(texts)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in _chunks(texts):
            doc, element, _ = shingles(texts[a:b])
            n = np.bincount(doc, minlength=b - a)
            full = np.flatnonzero(n)
            if not len(full):
                continue
            own = np.searchsorted(full, doc)
            registers = signatures(own, element, np.ones(len(element)), len(full))
            parts = registers.reshape(len(full), BANDS, BAND_ROWS)
            bands = (parts * _PLACE[:BAND_ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[BAND_ROWS]
            first = np.cumsum(n[full]) - n[full]
            prints = [np.add.reduceat(_mixed(element + np.uint64(s)), first) for s in (1, 2)]
            lists = [_lists(_mixed(bands)), _lists(parities(own, element, len(full)))]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(full + a)), _signed(prints[0]), _signed(prints[1]), pa.array(n[full], pa.int32()), *lists],
                names=["doc_id", "f1", "f2", "n", "bands", "parity"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text as sorted 64-bit numbers."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in _chunks(texts):
            doc, element, _ = shingles(texts[a:b])
            at = np.searchsorted(doc, np.arange(b - a + 1)) * 8
            data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(element)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), data], names=["doc_id", "items"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(one) + len(two) - len(np.union1d(one, two))
            keep.append(both >= SIMILARITY * (len(one) + len(two) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingle_sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, items`` for the documents of ``ids``. Texts are dealt out by id at every
    size, without a switch to a broadcast of the ids."""
    texts = documents.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")
    return staged(texts.dropDuplicates(["doc_id"]).mapInArrow(_sets, "doc_id long, items binary"), "shingle-sets")


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose shingle sets reach the similarity."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    met = pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").select("a", "b", "x", "y")
    return staged(met.mapInArrow(_similar, "a long, b long"), "near-pairs")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, component_id, kept`` for each row of ``documents`` (doc_id, text).

    Two documents link if the Jaccard similarity of their sets of five-word shingles is at
    least 0.8; a component is what links connect, its id the smallest doc_id, which alone
    is kept. Null texts and texts without words link with nothing. Rows that repeat a
    doc_id are one document: they share a row's fate.

    1. Every text gets a ProbMinHash signature of its distinct shingles at equal rates, so
       registers agree with the same Jaccard similarity that decides however often a passage
       repeats, and a fingerprint of its shingle set. Texts with equal fingerprints form a
       class; the smallest id stands for it from here on.
    2. Signatures are cut into bands; equal bands meet in a bucket. Each bucket's pivot is
       the member with the most company over all its buckets, and each member is verified
       against the pivots of its buckets. A document that many others were edited from is
       the pivot of them all, so large groups of near copies link by stars.
    3. Whatever members of a bucket are still in another component than its pivot meet all
       members outside their component. A pair is made in the first bucket that it shares,
       and inside the join those are left out whose set sizes or parities prove them
       dissimilar; all others are verified. After that every pair that met in a bucket is
       connected, has been verified, or is certainly dissimilar.

    Verification compares whole shingle sets. Copies of a class are joined by fingerprint
    at the end and are never expanded into pairs.
    """
    signed = staged(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(_sign, SIGNATURES), "signatures")
    least = signed.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "bands", "parity")).alias("v"))
    classes = staged(least.select("f1", "f2", F.col("v.doc_id").alias("rep"), "v.n", "v.bands", "v.parity"), "classes")
    meets = classes.select(F.posexplode("bands").alias("band", "bucket"), "rep")
    sizes = meets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    meets = staged(meets.join(sizes, "bucket"), "buckets")
    company = meets.groupBy("rep").agg(F.sum("size").alias("company"))
    company = staged(company, "company")
    sets = _shingle_sets(documents, company.select(F.col("rep").alias("doc_id")))
    pivots = meets.join(company, "rep").groupBy("bucket").agg(
        F.max(F.struct("company", (-F.col("rep")).alias("order"))).alias("p")
    )
    pivots = staged(pivots.select("bucket", (-F.col("p.order")).alias("pivot")), "pivots")
    ordered = [F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")]
    stars = meets.join(pivots, "bucket").where(F.col("rep") != F.col("pivot")).withColumnRenamed("pivot", "other")
    stars = staged(stars.select(*ordered).distinct(), "star-pairs")
    links = _verified(sets, stars)

    parts = staged(connected_components(links, "a", "b"), "components")
    part = F.coalesce("component", "rep")
    members = meets.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "rep", part.alias("part"))
    at_pivot = pivots.join(parts.withColumnRenamed("node", "pivot"), "pivot", "left")
    at_pivot = at_pivot.select("bucket", F.coalesce("component", "pivot").alias("main"))
    members = staged(members.join(at_pivot, "bucket"), "members")
    away = F.col("part") != F.col("main")
    split = members.where(away).select("bucket").distinct()
    members = members.join(split, "bucket", "left_semi").join(classes.select("rep", "n", "parity", "bands"), "rep")
    members = staged(members, "split-buckets")
    others = members.select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("rep", "part", "main", "n", "parity", "bands")])
    others = others.withColumnRenamed("other_rep", "other")
    both_away = (F.col("other_part") != F.col("other_main")) & (F.col("rep") > F.col("other"))
    alike = may_be_similar("n", "parity", "other_n", "other_parity")
    apart = (F.col("part") != F.col("other_part")) & ~both_away
    earlier = [F.slice(c, F.lit(1), F.col("band")) for c in ("bands", "other_bands")]
    met_before = F.exists(F.zip_with(*earlier, lambda x, y: x == y), lambda same: same)
    pairs = members.where(away).join(others, (members["bucket"] == others["bucket"]) & apart & alike & ~met_before)
    pairs = pairs.select(*ordered).distinct().join(stars, ["a", "b"], "left_anti")
    more = _verified(sets, staged(pairs, "more-pairs"))

    star = parts.where(F.col("node") != F.col("component")).select(F.col("node").alias("a"), F.col("component").alias("b"))
    joined = connected_components(star.union(more), "a", "b").withColumnRenamed("node", "rep")
    whole = signed.select("doc_id", "f1", "f2").distinct().join(classes.select("f1", "f2", "rep"), ["f1", "f2"])
    whole = whole.join(joined, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    component = F.coalesce("component", "doc_id")
    return (
        documents.select("doc_id")
        .join(whole, "doc_id", "left")
        .select("doc_id", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with one document of each component, in its columns.

    Of rows that repeat a doc_id one stays; rows without an id all stay.
    """
    gone = near_duplicates(documents).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    kept = documents.join(staged(gone, "dropped"), "doc_id", "left_anti").select(documents.columns)
    named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.union(documents.where(F.col("doc_id").isNull()))
