"""Hard negatives by a vertical scan of the dimensions with shrinking candidate sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm import multi_index as mi
from bazaarlens.llm.staging import staged

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LEAST_PCT, MOST_PCT = 30, 90
#: Rows of a block, in which one task scans the dimensions; small tables make about BLOCKS of them.
MIN_BLOCK_ROWS, MAX_BLOCK_ROWS, BLOCKS = 4_096, 65_536, 64
#: Dimensions read before candidates are looked at for the first time, and between two looks.
FIRST_LOOK, LOOK = 16, 8
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)


def _whole(column) -> np.ndarray:
    """Components as whole numbers in doubles."""
    return np.floor(SCALE * mi.matrix(column))


class Block:
    """Rows of one block, a column per dimension, and the least and largest value of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(rows[order].T)
        self.low, self.high = self.columns.min(1), self.columns.max(1)

    def scores(self, anchor: np.ndarray, live: np.ndarray, shrink: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that remain of ``live`` and their exact inner products with ``anchor``.

        Dimensions are read in the order of the anchor's magnitudes. What the others can
        still add lies between two sums, so a candidate's score lies in an interval;
        ``shrink(low, high)`` tells from the intervals which candidates stay.
        """
        largest = np.abs(anchor) * np.maximum(np.abs(self.low), np.abs(self.high))
        if largest.sum() >= EXACT:  # beyond doubles: whole numbers of any length
            rows = [[int(v) for v in self.columns[:, c]] for c in live]
            return live, np.array([sum(int(a) * v for a, v in zip(anchor, row, strict=True)) for row in rows], np.int64)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        rest = np.c_[np.cumsum(np.sort(ends, axis=0)[:, ::-1], axis=1)[:, ::-1], [0.0, 0.0]]
        known, at = np.zeros(len(live)), 0
        while at < len(order) and len(live):
            dims = order[at : at + (LOOK if at else FIRST_LOOK)]
            part = self.columns[dims] if len(live) == len(self.ids) else self.columns[np.ix_(dims, live)]
            known += anchor[dims] @ part
            at += len(dims)
            stay = shrink(known + rest[0, at], known + rest[1, at])
            live, known = live[stay], known[stay]
        return live, known.astype(np.int64)


def _among_best(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Candidates that may be among the ``k`` largest."""
    if len(low) <= k:
        return np.ones(len(low), bool)
    return high >= np.partition(low, len(low) - k)[len(low) - k]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def find_positives(block: Block, anchor_id: int, label, anchor: np.ndarray) -> list[tuple[int, int, int]]:
    live = np.flatnonzero((block.labels == label) & (block.ids != anchor_id))
    live, scores = block.scores(anchor, live, lambda low, high: _among_best(low, high, POSITIVES))
    ids = block.ids[live]
    return [(0, int(ids[b]), int(scores[b])) for b in _best(ids, scores, POSITIVES)]


def window(positive_score: int) -> tuple[int, int]:
    """Least and largest score of a negative, as whole numbers."""
    return -(-LEAST_PCT * positive_score // 100), MOST_PCT * positive_score // 100


def find_negatives(block: Block, label, anchor: np.ndarray, positives: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``positives`` are ids and scores; equal scores share a window."""
    windows = {score: window(score) for _, score in positives}
    windows = {score: w for score, w in windows.items() if w[0] <= w[1]}

    def shrink(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for first, last in windows.values():
            meets = (high >= first) & (low <= last)
            sure = low[(low >= first) & (high <= last)]
            if len(sure) > NEGATIVES:
                meets &= high >= np.partition(sure, len(sure) - NEGATIVES)[len(sure) - NEGATIVES]
            stay |= meets
        return stay

    live = np.flatnonzero(block.labels != label) if windows else np.zeros(0, np.int64)
    live, scores = block.scores(anchor, live, shrink)
    ids, out = block.ids[live], []
    for positive, score in positives:
        if score in windows:
            inside = np.flatnonzero((scores >= windows[score][0]) & (scores <= windows[score][1]))
            best = inside[_best(ids[inside], scores[inside], NEGATIVES)]
            out += [(positive, int(ids[b]), int(scores[b])) for b in best]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block come first, then the anchors that look at it, one after another; only
    the block is held. Without ``positives`` an anchor looks for positives, with them for negatives."""
    block, held, number = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _whole(batch.column("embedding"))
        ids, labels = np.asarray(batch.column("vec_id")), batch.column("label").to_numpy(zero_copy_only=False)
        blocks, anchors = np.asarray(batch.column("block")), np.asarray(batch.column("anchor").cast(pa.int8()))
        out: list[list] = [[], [], [], []]
        edges = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (anchors[1:] != anchors[:-1]), True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if number != blocks[a]:
                block, held, number = None, [], blocks[a]
            if not anchors[a]:
                held.append((ids[a:b], labels[a:b], rows[a:b]))
                continue
            if block is None and held:
                block, held = Block(*map(np.concatenate, zip(*held, strict=True))), []
            for r in range(a, b) if block else ():
                positives = batch.column("positives")[r].as_py()
                if positives is None:
                    found = find_positives(block, ids[r], labels[r], rows[r])
                else:
                    found = find_negatives(block, labels[r], rows[r], [(p["vec_id"], p["score"]) for p in positives])
                out[0] += [ids[r]] * len(found)
                for column, values in zip(out[1:], zip(*found, strict=True), strict=False):
                    column += values
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "vec_id", "score"])


def _looked_up(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Each anchor's finds in each block. Rows are sent once; an anchor is sent to every block."""
    entries = rows.select(
        "vec_id", "label", "embedding", F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("anchor"),
    )
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    sent = entries.union(anchors.select("vec_id", "label", "embedding", "positives", copies, F.lit(True).alias("anchor")))
    dealt = sent.repartition(blocks, "block").sortWithinPartitions("block", "anchor")
    return dealt.mapInArrow(_scan, "anchor_id long, positive_id long, vec_id long, score long")


def _ranked(found: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order))


def mine(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has vec_id, embedding and label; anchors are its rows with ``is_anchor``.
    Components x count as floor(256 * x), and a score is the exact inner product of whole
    numbers. An anchor's positives are the five other rows of its label with the highest
    scores, its negatives for a positive the ten rows of other labels with the highest
    scores between 30% and 90% of the positive's; ties go to the smaller vec_id.

    Rows with a null label, id or vector, of another than the most frequent length, or with
    null or non-finite components take no part; zero vectors do. Rows that repeat a vec_id
    count as one (the least stays). An anchor without positives, and a positive without
    negatives, give no rows. A score beyond 64 bits is an error.

    Rows are dealt by a hash into blocks of bounded size, whatever share a label has. A task
    holds one block by dimensions and scans them for one anchor after another in the order
    of the anchor's magnitudes; the least and largest values of the dimensions still unread
    bound each candidate's score, and those that can no longer be among the best, or in a
    positive's window, are dropped. A block returns at most five rows per anchor, then at
    most ten per positive, and the best of all blocks are ranked.
    """
    dim = mi.common_dim(vectors, "embedding")
    inf = float("inf")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == inf))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") == dim) & ~bad
    rows = vectors.where(F.coalesce(usable, F.lit(False))).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
    rows = staged(rows.select("vec_id", "v.label", "v.embedding"), "mining-rows")
    total = rows.count()
    blocks = max(1, -(-total // min(MAX_BLOCK_ROWS, max(MIN_BLOCK_ROWS, total // BLOCKS))))
    anchors = rows.where(is_anchor)
    none = F.lit(None).cast("array<struct<score:bigint,vec_id:bigint>>").alias("positives")
    near = _ranked(_looked_up(rows, anchors.select("*", none), blocks), "anchor_id").where(F.col("rank") <= POSITIVES)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "vec_id")).alias("positives"))
    near = staged(near, "mining-positives")
    seeking = anchors.join(near.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = _ranked(_looked_up(rows, seeking, blocks), "anchor_id", "positive_id").where(F.col("rank") <= NEGATIVES)
    scores = near.select("anchor_id", F.inline("positives")).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
