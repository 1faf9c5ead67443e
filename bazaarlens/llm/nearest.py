"""Exact nearest neighbours through an inverted multi-index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm import multi_index as mi
from bazaarlens.llm.staging import staged

SAMPLE_ROWS, CELL_ROWS, MAX_CODES = 16_384, 64, 256
ENTRY_ROWS, QUERY_ROWS = 2_048, 256
#: Relative slack for distances that come from dot products.
SLACK = 1e-9


def _ceiling(x: np.ndarray, own: np.ndarray, sample: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Squared distances below which each query has ``k`` neighbours in the sample alone."""
    d = mi._squares(x, sample)
    d[own[:, None] == keys[None]] = np.inf
    if d.shape[1] < k:
        return np.full(len(x), np.inf)
    scale = (x * x).sum(1) + (sample * sample).sum(1).max(initial=0)
    return np.partition(d, k - 1, axis=1)[:, k - 1] + SLACK * scale


def _code(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value[0]
        for batch in batches:
            if batch.num_rows:
                i, j = index.codes(mi.matrix(batch.column(1)))
                arrays = [*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "embedding", "band", "code"])

    return run


def _traverse(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells of each query, one row per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, keys, sample = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = mi.matrix(batch.column(1))
            one, two = index.bounds(x)
            top = _ceiling(x, np.asarray(batch.column(0)), sample, keys, k)
            rows, bands, codes = [], [], []
            for row in range(len(x)):
                cells: dict[int, list[int]] = {}
                for i, j in mi.visited(one[row], two[row], top[row]):
                    cells.setdefault(i, []).append(j)
                rows += [row] * len(cells)
                bands += cells.keys()
                codes += cells.values()
            take = pa.array(rows, pa.int64())
            arrays = [c.take(take) for c in batch.columns]
            arrays += [pa.array(bands, pa.int32()), pa.array(codes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "embedding", "band", "codes"])

    return run


def _rerank(k: int, codes: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Each query's ``k`` nearest entries among the visited cells of a block."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        q, e = block[block["codes"].notna()], block[block["codes"].isna()]
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(e):
            x, y = (np.stack(d["embedding"]).astype(np.float64) for d in (q, e))
            ids, code = e["vec_id"].to_numpy(), e["code"].to_numpy()
            d = mi._squares(x, y)
            slack = 2 * SLACK * ((x * x).sum(1) + (y * y).sum(1).max())
            for row, (own, cells) in enumerate(zip(q["vec_id"], q["codes"], strict=True)):
                reach = np.zeros(codes, bool)
                reach[cells] = True
                live = np.flatnonzero(reach[code] & (ids != own))
                if len(live) > k:
                    near = d[row, live]
                    live = live[near <= np.partition(near, k - 1)[k - 1] + slack[row]]
                score = np.sqrt(np.cumsum((x[row] - y[live]) ** 2, axis=1)[:, -1])
                best = np.lexsort((ids[live], score))[:k]
                out["query_id"] += [own] * len(best)
                out["vec_id"] += ids[live[best]].tolist()
                out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": np.int64, "vec_id": np.int64, "score": np.float64})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int, seed: int = 0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other vectors of each query.

    ``vectors`` has vec_id and embedding; queries are its rows with ``is_query``. The score
    is the Euclidean distance in doubles, summed in the order of the components; ties go
    to the smaller vec_id. Vectors that are null, of another than the most frequent
    length, zero, or with null or non-finite components take no part, as do null ids. Rows
    that repeat a vec_id count as one vector (the least stays).

    Codebooks are fitted to at most ``SAMPLE_ROWS`` vectors; every vector is an entry. A
    query's k-th distance inside the sample bounds its true one, so it visits cells by
    summed bound from a heap until the bound exceeds that. No entry outside can be among
    the nearest: the search is exact, and spread-out vectors only make it visit more.

    Queries meet entries in blocks of a band; a band with many of either is dealt into
    more blocks. Each block returns at most ``k`` rows per query.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & mi.usable("embedding", mi.common_dim(vectors, "embedding")))
    rows = staged(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    total = rows.count()
    spark = vectors.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    keys, sample = mi.fit_sample(rows, "vec_id", "embedding", total, SAMPLE_ROWS, seed)
    codes = int(min(max(4, round((total / CELL_ROWS) ** 0.5)), MAX_CODES, max(1, len(sample) // 16)))
    index = mi.MultiIndex.fit(sample, codes, seed)
    shared = spark.sparkContext.broadcast((index, keys, sample))
    kind = dict(rows.dtypes)["embedding"]
    coded = rows.mapInArrow(_code(shared), f"vec_id long, embedding {kind}, band int, code int")
    coded = staged(coded, "coded-vectors")
    search = rows.where(is_query).mapInArrow(_traverse(shared, k), f"vec_id long, embedding {kind}, band int, codes array<int>")
    search = staged(search, "searches")
    blocks = (
        coded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / ENTRY_ROWS).cast("int").alias("e_blocks"))
        .join(search.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("q_blocks")), "band")
    )
    blocks = staged(blocks, "vector-blocks")

    def part(name: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(name)).cast("int")

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    columns = ["vec_id", "embedding", "band", "code", "codes", "e", "q"]
    entries = coded.withColumn("codes", F.lit(None).cast("array<int>")).join(blocks, "band")
    entries = entries.withColumn("e", part("e_blocks", 1)).withColumn("q", every("q_blocks")).select(columns)
    search = search.withColumn("code", F.lit(-1)).join(blocks, "band")
    search = search.withColumn("q", part("q_blocks", 2)).withColumn("e", every("e_blocks")).select(columns)
    found = entries.union(search).groupBy("band", "e", "q").applyInPandas(
        _rerank(k, len(index.second)), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
