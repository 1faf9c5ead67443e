"""Guarded ratios, decimal rounding, bands and one-row statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL where the denominator is zero (ANSI mode would fail)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rounded(value: Column, digits: int, working_scale: int = 12) -> Column:
    """Half-up rounding done on a decimal, so 2.675 becomes 2.68 whatever its binary form.

    The decimal keeps 12 places: enough that no reported value is rounded twice, and few
    enough to absorb the last bits that a sum of doubles gains in another order.
    """
    return F.round(value.cast(f"decimal(38,{working_scale})"), digits).cast("double")


def mean(value: Column) -> Column:
    """Mean of an exact (decimal or integer) column, as the double of sum over count."""
    return ratio(F.sum(value), F.count(value))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return rounded(ratio(part * F.lit(100), whole), digits)


def bands(value: Column, edges: Sequence[float | None], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval ``(edges[i], edges[i+1]]`` that holds the value.

    ``None`` as the last edge leaves the top open. Values outside all intervals give NULL.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = value > F.lit(low)
        if high is not None:
            inside = inside & (value <= F.lit(high))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def band_order(label: Column, labels: Sequence[str]) -> Column:
    """Position of a band label, for sorting by band rather than by text."""
    out = None
    for position, name in enumerate(labels):
        hit = label == F.lit(name)
        out = F.when(hit, position) if out is None else out.when(hit, position)
    return out


def with_totals(df: DataFrame, source: DataFrame, out: str = "_all", **aggregates: Column) -> DataFrame:
    """Adds whole-table aggregates of ``source`` to every row, as the struct column ``out``.

    They come from a scalar subquery, which yields exactly one row: no join is planned and
    nothing that grows with the data is sent to the executors. The struct is referenced
    through one column, so the subquery stands once in the plan however many fields are used.
    """
    fields = [aggregate.alias(name) for name, aggregate in aggregates.items()]
    return df.withColumn(out, source.agg(F.struct(*fields).alias(out)).scalar())


def z_score(value: Column, mu: Column, sigma: Column) -> Column:
    """(value - mu) / sigma, and 0 where sigma is zero or unknown."""
    return F.coalesce(F.try_divide(value.cast("double") - mu.cast("double"), sigma), F.lit(0.0))
