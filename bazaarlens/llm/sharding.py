"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.staging import staged

#: Rows of a chunk, the unit that is permuted in one task; and chunks of scan partitions drawn together.
CHUNK_BITS, GROUP_BITS = 13, 10


def _rise(a: float, d: float) -> float:
    """``lgamma(a + d) - lgamma(a)`` for large ``a`` without cancellation."""
    b = a + d
    return (a - 0.5) * math.log1p(d / a) + d * math.log(b) - d + (1 / b - 1 / a) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good.

    numpy draws populations below 10^9; above, a ratio of uniforms against the exact
    probabilities relative to the mode.
    """
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    if n > total - n:
        return good - hypergeometric(rng, good, bad, total - n)
    mean = n * good / total
    width = math.sqrt((total - n) * (n / total) * (good / total) * (bad / (total - 1)) + 0.5)
    mode = (n + 1) * (good + 1) // (total + 2)
    low, high = max(0, n - bad), min(n, good)
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + (1.7155277699214135 * width + 0.8989161620588988) * (v - 0.5) / max(u, 1e-300))
        if not low <= k <= high:
            continue
        d = k - mode
        terms = ((mode + 1, d), (good - mode + 1, -d), (n - mode + 1, -d), (bad - n + mode + 1, d))
        ratio = sum(math.lgamma(a + s) - math.lgamma(a) if min(a, a + s) < 1e5 else _rise(a, s) for a, s in terms)
        if u > 0 and 2 * math.log(u) <= -ratio:
            return k


def draw_row(rng: np.random.Generator, capacities: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows go to each shard, and takes them off ``capacities``."""
    out, rest = np.zeros(len(capacities), np.int64), int(capacities.sum())
    for s, room in enumerate(capacities.tolist()):
        rest -= room
        out[s] = hypergeometric(rng, room, rest, n) if n and room else 0
        n -= int(out[s])
    capacities -= out
    return out


def _draw_chunks(shards: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def draw(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("chunk")
        group = int(chunks["group"].iloc[0])
        rng = np.random.default_rng([seed, 1, group])
        room = np.array(chunks["room"].iloc[0], dtype=np.int64)
        bounds = [np.cumsum(draw_row(rng, room, int(n))).tolist() for n in chunks["n"]]
        return pd.DataFrame({"chunk": chunks["chunk"].to_numpy(), "bounds": bounds})

    return draw


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``row`` (a struct of the input's columns), ``shard`` and ``slot`` for every row.

    Every assignment of rows to slots is equally likely (up to the random numbers used);
    shard sizes differ by at most one row and slots of a shard count from 0 without gaps.

    1. The rows of each scan partition are permuted where they are read, numbered in that
       order and written, so the numbers are data. Chunks are runs of numbers inside one
       scan partition.
    2. The matrix of rows per chunk and shard is drawn with exact sums: first per group of
       chunks from the shard sizes, on the driver (one small row per 1,024 scan
       partitions), then per chunk from the group's draw, in tasks.
    3. A chunk's matrix row deals its numbers out in turn. It joins as one small row per
       8,192 rows, which Spark broadcasts while it measures under the broadcast threshold.
    4. Rows are exchanged by shard and by a random bucket of it, the only exchange that
       carries them, and permuted again; the slot is the rank in the bucket plus the sizes
       of the buckets before.

    Nulls, repeated rows and empty texts are rows like others; an empty table gives none.
    """
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    permuted = rows.select(place.alias("place"), F.struct(*rows.columns).alias("row")).sortWithinPartitions("place")
    table = staged(permuted.select(F.monotonically_increasing_id().alias("id"), "row"), "shard-rows")
    chunk_of, rank = F.shiftright("id", CHUNK_BITS), F.col("id") % (1 << CHUNK_BITS)
    counts = table.groupBy(chunk_of.alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts.withColumn("group", F.shiftright("chunk", 33 - CHUNK_BITS + GROUP_BITS)), "shard-chunks")
    groups = counts.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").collect()
    total = sum(g.n for g in groups)
    room = np.full(shards, total // shards, np.int64)
    rng = np.random.default_rng([seed, 0])
    room[rng.permutation(shards)[: total % shards]] += 1
    drawn = [(g.group, draw_row(rng, room, g.n).tolist()) for g in groups]
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("room", T.ArrayType(T.LongType()))])
    matrix = (
        counts.join(spark.createDataFrame(drawn, schema), "group")
        .groupBy("group")
        .applyInPandas(_draw_chunks(shards, seed), "chunk long, bounds array<long>")
    )
    matrix = staged(matrix, "shard-matrix")
    buckets = max(1, total // shards >> CHUNK_BITS)
    key = F.xxhash64("id", F.lit(seed + 1))
    shard = F.size(F.filter("bounds", lambda b: b <= rank)).cast("int")
    dealt = table.withColumn("chunk", chunk_of).join(matrix, "chunk")
    dealt = dealt.select("id", "row", shard.alias("shard"), key.alias("key"), F.pmod(key, F.lit(buckets)).alias("bucket"))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    again = Window.partitionBy("shard", "bucket").orderBy("key", "id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards * buckets)
    return (
        dealt.repartition(parts, "shard", "bucket")
        .withColumn("rank", F.row_number().over(again) - 1)
        .join(sizes, ["shard", "bucket"])
        .select("row", "shard", (F.col("before") + F.col("rank")).alias("slot"))
    )
