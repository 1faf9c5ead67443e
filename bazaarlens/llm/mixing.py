"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm.staging import staged

#: Characters that separate words, and the golden ratio's share of 2^31 made odd.
WORD = r"[^\x20\x09-\x0D]+"
PERIOD_BITS, GOLDEN = 31, 1327217885
#: Sources are a catalogue that the driver reads; documents, blocks and slots are not.
MAX_SOURCES = 10_000
SLOT_CHUNK_BITS, BUCKET_ROWS = 14, 8192


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, passes: float) -> list[float]:
    """Splits ``total`` by weight; no source gets more than ``passes`` times its size.

    The excess goes to the others by weight until none is above: sources fill up in order
    of size per weight, so one walk in that order finds all full ones.
    """
    out = [0.0] * len(sizes)
    rest, weight = float(total), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: (passes * sizes[i] / weights[i], i))
    for at, i in enumerate(order):
        if passes * sizes[i] / weights[i] <= rest / weight:
            out[i] = float(passes * sizes[i])
            rest, weight = rest - out[i], weight - weights[i]
        else:
            for k in order[at:]:
                out[k] = rest * weights[k] / weight
            break
    return out


def _points(slot: Column) -> Column:
    """Golden-ratio points in units of 2^-31: every run of 2^31 slots holds each point once."""
    mod = 1 << PERIOD_BITS
    return F.pmod(F.pmod(slot, F.lit(mod)) * F.lit(GOLDEN), F.lit(mod))


def _schedule(documents: DataFrame, shares: Sequence[float], blocks: Sequence[int]) -> DataFrame:
    """``slot, src, rank``: slots 0, 1, ... pick sources in proportion to ``shares``; the
    ranks of each source reach ``blocks`` at least.

    A slot's rank is its row number inside a chunk of slots plus the counts of the source
    in the chunks before, so no source needs one task. There are as many slots as blocks.
    Points miss a source's share by a few at most (by the logarithm of the slots), so only
    that many blocks of a source, or all of a very small one, find no slot; they get slots
    of their own at the end.
    """
    spark = documents.sparkSession
    total = sum(shares)
    slots = sum(blocks)
    bounds, run = [], 0.0
    for share in shares:
        run += share
        bounds.append(round((1 << PERIOD_BITS) * run / max(total, 1e-300)))
    src = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[:-1]]).cast("array<long>"), lambda b: b <= F.col("point")))
    picked = spark.range(slots).select(
        F.col("id").alias("slot"), F.shiftright("id", SLOT_CHUNK_BITS).alias("chunk"), _points(F.col("id")).alias("point")
    )
    picked = picked.select("slot", "chunk", src.alias("src"))
    counts = picked.groupBy("chunk", "src").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    each = counts.select("chunk", "src", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("chunk", "src").orderBy("slot")
    ranked = (
        picked.withColumn("rank", F.row_number().over(inside) - 1)
        .join(each, ["chunk", "src"])
        .select("slot", "src", (F.col("before") + F.col("rank")).alias("rank"))
    )
    wanted = spark.createDataFrame([(i, b, slots + i) for i, b in enumerate(blocks)], "src int, blocks long, at long")
    have = wanted.join(counts.groupBy("src").agg(F.sum("n").alias("n")), "src", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    late = have.where("n < blocks").select("src", "at", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("rank"), "n")
    # Round after round of the sources that still have blocks, so the end is mixed, too.
    late = late.select((F.col("at") + (F.col("rank") - F.col("n")) * len(blocks)).alias("slot"), "src", "rank")
    return ranked.union(late)


def mix(
    documents: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    passes: int = 2,
    block: int = 512,
    seed: int = 0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Pieces of documents (doc_id, text, source) in the order of a mixing schedule.

    Returns ``doc_id, copy, crc, size, source_size, target, slot, epoch, first, last``:
    slot ``slot`` takes words ``first`` to ``last`` (exclusive) of the document, whose text
    has the CRC-32 ``crc``, in its source's pass ``epoch``. A document from which nothing
    is taken has one row with null slot. ``copy`` tells rows apart, also those that share a
    doc_id or have none. Columns named in ``carry`` come along.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times all
    words; none gets more than ``passes`` times its own. A source's documents, in an order
    shuffled by a hash, form a stream that is cut into blocks of ``block`` words. Slots
    pick sources by golden-ratio points among the cumulative targets; a source's slot of
    rank r takes block r of the repeated stream. The slot that reaches the target takes
    only what is missing, so each source's words equal its target rounded to a word, and
    no word is taken more than ``passes`` times. Null and empty texts have no words.

    Stream offsets come from sums per bucket of hashes plus a window inside the bucket;
    blocks and slots are joined on source and block, where each side has few rows.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed or ''}"), text)
    base = documents.select(
        "doc_id", "source", words.alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.md5(key.cast("binary")).alias("hash"), *carry
    )
    base = staged(base.withColumn("row", F.monotonically_increasing_id()), "mix-documents")
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.size for r in found]
    weights = [float(weights[i % len(weights)]) for i in range(len(found))]
    goal = targets(sizes, weights, share * sum(sizes), passes)
    goal = [min(g, float(passes * s)) for g, s in zip(goal, sizes, strict=True)]
    counts = [-(-s // block) for s in sizes]

    spark = documents.sparkSession
    listed = [(i, r.source, s, g, int(g + 0.5)) for i, (r, s, g) in enumerate(zip(found, sizes, goal, strict=True))]
    catalogue = spark.createDataFrame(listed, "src int, source string, source_size long, target double, goal long")
    docs = base.join(F.broadcast(catalogue), base["source"].eqNullSafe(catalogue["source"])).drop("source")

    buckets = max(1, max((r.n for r in found), default=1) // BUCKET_ROWS)
    docs = docs.withColumn("bucket", F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % buckets)
    sums = docs.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("hash", "doc_id", "crc", "row")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    docs = docs.withColumn("inside", running).join(sums, ["src", "bucket"])
    docs = docs.withColumn("start", F.col("before") + F.col("inside")).withColumn("end", F.col("start") + F.col("size"))

    cuts = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    pieces = docs.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, cuts)))
    pieces = pieces.select(
        "doc_id", "row", "crc", "size", "source_size", "target", "goal", "src", "start", "end", "block", *carry,
        F.greatest(F.col("start"), F.col("block") * block).alias("a"),
        F.least(F.col("end"), (F.col("block") + 1) * block).alias("b"),
    )
    per_source = F.array(*[F.lit(c) for c in counts or [1]]).cast("array<long>")
    n_blocks = F.element_at(per_source, (F.col("src") + 1).cast("int"))
    wanted = [int(g + 0.5) for g in goal]
    ranks = [w // s * c + -(-(w % s) // block) if s else 0 for w, s, c in zip(wanted, sizes, counts, strict=True)]
    slots = _schedule(documents, goal, ranks).where(n_blocks > 0)
    slots = slots.select(
        "slot", "src", F.floor(F.col("rank") / n_blocks).alias("epoch"), F.pmod("rank", n_blocks).alias("block")
    ).where(F.col("epoch") < passes)
    limit = F.least(F.col("b"), F.col("goal") - F.col("epoch") * F.col("source_size"))
    taken = pieces.join(slots, ["src", "block"], "left").withColumn("stop", limit)
    took = F.col("slot").isNotNull() & (F.col("stop") > F.col("a"))
    taken = taken.select(
        "doc_id", "row", "crc", "size", "source_size", "target", *carry,
        *[F.when(took, F.col(c)).alias(c) for c in ("slot", "epoch")],
        F.when(took, F.col("a") - F.col("start")).alias("first"),
        F.when(took, F.col("stop") - F.col("start")).alias("last"),
    )
    return taken.withColumnRenamed("row", "copy")


def taken_words(pieces: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document of :func:`mix`."""
    total = F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0))
    found = pieces.groupBy("doc_id", "copy", "size", "source_size", "target").agg(total.alias("taken"))
    return found.drop("copy")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``documents``: one for each pass that takes words from a document.

    The text is the words taken in that pass: all of it, or for the last document that a
    source needs the leading words, joined by single spaces; ``n_chars``, where there is
    such a column, counts what is left. Every row of ``documents`` is a document of its own,
    also if it has no doc_id or shares one. The rows of each partition, and so of each
    written file, are in the order of the schedule.

    Texts join what is taken from them by 128 bits of all their columns; rows with all
    columns equal stand for each other.
    """
    columns = documents.columns
    key = F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))
    keyed = documents.withColumn("__key", key)
    pieces = mix(keyed, carry=["__key"], **options).where(F.col("slot").isNotNull())
    passes = pieces.groupBy("__key", "copy", "size", "epoch").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("slot").alias("slot")
    )
    takes = passes.select("__key", F.struct("slot", "copy", "first", "last", "size").alias("__take"))
    rows = keyed.dropDuplicates(["__key"]).join(takes, "__key")
    first, last = F.col("__take.first"), F.col("__take.last")
    whole = last - first == F.col("__take.size")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.slice(words, (first + 1).cast("int"), (last - first).cast("int"))
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(part, " ")))
    if "n_chars" in columns:
        count = F.length("text").cast(dict(documents.dtypes)["n_chars"])
        rows = rows.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(count))
    return rows.sortWithinPartitions("__take").select(columns)
