"""Inverted multi-index: a product grid of two codebooks, one per vector half.

A vector lies in the cell of its two nearest centroids. The distance from a vector to a
cell is bounded from below, half by half, by its distance to the plane between its own
centroid and the cell's; squared bounds of both halves add up. Cells are visited in order
of that sum by the multi-sequence traversal.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.staging import hashed_fraction

ROUNDS = 12


def usable(vector: str, dim: int) -> Column:
    """The vector has ``dim`` components, all finite, not all zero."""
    v = F.col(vector)
    inf = float("inf")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == inf))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def common_dim(vectors: DataFrame, vector: str) -> int:
    """The most frequent number of components (the larger one of equally frequent ones); 0 without vectors."""
    sizes = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
    row = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def matrix(column) -> np.ndarray:
    """Doubles from an Arrow list column without nulls, one row per vector."""
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = np.asarray(values.flatten()).astype(np.float64)
    return flat.reshape(len(values), len(flat) // max(1, len(values)))


def fit_sample(vectors: DataFrame, key: str, vector: str, total: int, rows: int, seed: int, *extra: str) -> tuple:
    """Keys and vectors of at most ``rows`` rows, chosen by a hash of the key, and lists of the ``extra`` columns."""
    chosen = vectors.where(hashed_fraction(F.col(key), rows / max(1, total), seed)).limit(rows)
    table = chosen.select(key, vector, *extra).toArrow()
    keys = np.asarray(table.column(0)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    more = [table.column(2 + k).take(order).to_pylist() for k in range(len(extra))]
    return keys[order], matrix(table.column(1))[order], *more


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from distinct start rows; empty centroids keep their place."""
    start = np.unique(x, axis=0)
    c = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(ROUNDS):
        near = _squares(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, seed: int) -> MultiIndex:
        h, rng = (sample.shape[1] + 1) // 2, np.random.default_rng(seed)
        return cls(_means(sample[:, :h], k, rng), _means(sample[:, h:], k, rng))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return x[:, :h], x[:, h:]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return _squares(a, self.first).argmin(1), _squares(b, self.second).argmin(1)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower bounds of the distance from each row to each code, for both halves."""
        out = []
        for part, c in zip(self.halves(x), (self.first, self.second), strict=True):
            d = _squares(part, c)
            own = d.argmin(1)
            apart = np.sqrt(_squares(c, c))
            gap = (d - d.min(1)[:, None]) / np.maximum(2 * apart[own], 1e-12)
            gap[np.arange(len(part)), own] = 0
            out.append(gap * gap)
        return out[0], out[1]


def multi_sequence(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs of positions by ascending sum ``one[i] + two[j]``, from a heap.

    A pair enters the heap once its neighbours before it in both sorted orders are out.
    """
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    p, q = one[a].tolist(), two[b].tolist()
    heap = [(p[0] + q[0], 0, 0)]
    done = [0] * len(p)  # how many of row i's pairs are out
    while heap:
        s, i, j = heapq.heappop(heap)
        done[i] = j + 1
        yield s, int(a[i]), int(b[j])
        if i + 1 < len(p) and done[i + 1] == j:
            heapq.heappush(heap, (p[i + 1] + q[j], i + 1, j))
        if j + 1 < len(q) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (p[i] + q[j + 1], i, j + 1))


def visited(one: np.ndarray, two: np.ndarray, within: float) -> list[tuple[int, int]]:
    """The cells whose summed bound is at most ``within``, nearest first."""
    out = []
    for s, i, j in multi_sequence(one, two):
        if s > within:
            break
        out.append((i, j))
    return out
