"""Exact order statistics and histograms that never gather all values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.numeric import with_totals

def _scaled(value: Column, digits: int) -> Column:
    """A value with at most ``digits`` decimals as a whole number."""
    return (value.cast(f"decimal(38,{max(digits, 8)})") * F.lit(10**digits)).cast("long")


# A bucket holds the whole numbers that agree in sign and in their leading bits.
LEADING_BITS = 17


def _bucket() -> Column:
    """The bucket of ``v``, ascending with it. Buckets are single values up to 2^17 and about
    0.001% wide above; 64-bit numbers have fewer than 6.5 million of them."""
    shift = f"greatest(length(bin(abs(v))) - {LEADING_BITS}, 0)"
    return F.expr(f"sign(v) * (shiftright(abs(v), {shift}) + {shift} * {1 << LEADING_BITS - 1}L)").cast("long")


def exact_quantile(df: DataFrame, value: str, p: float, out: str = "quantile", digits: int = 2) -> DataFrame:
    """One row holding the linearly interpolated ``p`` quantile of ``value``, which has at
    most ``digits`` decimals.

    ``percentile`` would keep every distinct value in a single buffer. Here copies of a
    value are counted on the map side. One aggregate of the counts gives the total of each
    bucket (:func:`_bucket`), of which there is a bounded number; a second one looks only
    into the bucket that holds the rank, and the next one. Values are compared and never
    subtracted, so no range of values is too wide.
    """
    values = df.select(_scaled(F.col(value), digits).alias("v")).where(F.col("v").isNotNull())
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("copies"))
    ranges = counted.groupBy(_bucket().alias("bucket"))
    ranges = ranges.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("copies").alias("n"))
    # One row per bucket.
    through = F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    position = F.lit(p) * (F.sum("n").over(Window.partitionBy()) - 1).cast("double")
    placed = ranges.select("low", "high", "n", through.alias("through"), position.alias("position"))
    below, rank = F.col("through") - F.col("n"), F.floor("position")
    held = placed.where((F.col("through") > rank) & (below <= rank + 1)).agg(
        F.struct(F.min("low").alias("low"), F.max("high").alias("high"), F.min(below).alias("below"), F.max("position").alias("position")).alias("w")
    )
    w = F.col("_w")
    inside = counted.withColumn("_w", held.scalar()).where((F.col("v") >= w.low) & (F.col("v") <= w.high))
    reached = F.sum("copies").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = inside.select("v", (reached + w.below).alias("reached"), w.position.alias("position")).agg(
        F.min(F.when(F.col("reached") > rank, F.col("v"))).alias("lower"),
        F.min(F.when(F.col("reached") > rank + 1, F.col("v"))).alias("upper"),
        F.max("position").alias("position"),
    )
    unit = float(10**digits)
    lower, upper = F.col("lower") / unit, F.col("upper") / unit
    share = F.col("position") - rank
    return ends.select((lower + F.when(share > 0, (upper - lower) * share).otherwise(0.0)).alias(out))


def equal_width_histogram(df: DataFrame, value: str, bins: int, digits: int) -> DataFrame:
    """Counts in ``bins`` equal intervals between the minimum and maximum, empty bins included.

    The last interval is closed. ``value`` has ``digits`` decimals, which makes the bin
    number an integer division and free of rounding at the edges. A constant column is
    spread over one unit centred on the value.
    """
    scaled = df.select(_scaled(F.col(value), digits).alias("v"))
    scaled = scaled.where(F.col("v").isNotNull())
    limited = with_totals(scaled, scaled, low=F.min("v"), high=F.max("v")).select("v", "_all.low", "_all.high")
    above, span = (f"cast({x} as decimal(20,0)) - low" for x in ("v", "high"))
    position = F.expr(f"(({above}) * {bins}) div nullif({span}, 0)")
    counted = limited.groupBy(
        "low",
        "high",
        F.when(position >= bins, bins - 1).otherwise(F.coalesce(position, F.lit(bins // 2))).cast("int").alias("bin"),
    ).agg(F.count(F.lit(1)).alias("frequency"))
    # At most ``bins`` rows are left; one map of them fills the empty bins with zero.
    filled = counted.groupBy("low", "high").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "frequency"))).alias("found")
    )
    unit = float(10**digits)
    spread = F.col("high") > F.col("low")
    start = F.when(spread, F.col("low") / unit).otherwise(F.col("low") / unit - 0.5)
    width = F.when(spread, (F.col("high").cast("decimal(20,0)") - F.col("low")).cast("double") / unit).otherwise(1.0)
    return filled.select(
        "found",
        start.alias("start"),
        width.alias("width"),
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    ).select(
        "bin",
        (F.col("start") + F.col("width") * F.col("bin") / bins).alias("bin_start"),
        (F.col("start") + F.col("width") * (F.col("bin") + 1) / bins).alias("bin_end"),
        F.coalesce(F.try_element_at("found", "bin"), F.lit(0)).alias("frequency"),
    )
