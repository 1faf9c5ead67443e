"""Data-quality gates: duplicates, missing values, ranges and row constraints.

The audits report; only :func:`drop_duplicate_keys` changes data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.numeric import ratio, rounded


def drop_duplicate_keys(df: DataFrame, keys: Sequence[str], first_by: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``first_by`` order, then in the order of the other columns.

    Filtering a row number to 1 makes Spark keep one row per key in every map task before
    the shuffle, so a key with very many copies sends at most one row per task. Ordering by
    every column makes the choice complete, and it fixes the columns of the shuffle: a plan
    that uses the deduplicated table several times computes it once, because AQE finds the
    same exchange again.
    """
    others = [c for c in df.columns if c not in keys and c not in first_by]
    order = Window.partitionBy(*keys).orderBy(*first_by, *others)
    return df.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")


def duplicate_audit(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows, distinct keys and surplus rows. Counts per key are combined on the map side."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    counted = counted.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_keys"))
    return duplicate_report(counted, name)


def duplicate_report(counted: DataFrame, name: str) -> DataFrame:
    """The audit from one row with ``row_count`` and ``distinct_keys``."""
    surplus = (F.col("row_count") - F.col("distinct_keys")).alias("duplicate_rows")
    return counted.select(F.lit(name).alias("table_name"), "row_count", "distinct_keys", surplus)


def null_counts(columns: Sequence[str]) -> dict[str, Column]:
    """Aggregates for :func:`null_report`."""
    return {"row_count": F.count(F.lit(1))} | {f"null_{c}": F.count_if(F.col(c).isNull()) for c in columns}


def null_report(counted: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Missing values per critical column from one row of :func:`null_counts`."""
    labelled = _by_label(counted, {c: f"null_{c}" for c in columns}, "column_name", "null_count", "row_count")
    return labelled.select(
        F.lit(name).alias("table_name"),
        "column_name",
        "null_count",
        F.coalesce(rounded(ratio(F.col("null_count"), F.col("row_count")), 4), F.lit(0.0)).alias("null_share"),
    )


def null_audit(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Missing values per critical column, all counted in one pass."""
    return null_report(_counted(df, null_counts(columns)), columns, name)


def unreadable_counts(columns: Sequence[str], unreadable: str) -> dict[str, Column]:
    """Aggregates for :func:`unreadable_report`."""
    return {f"unreadable_{c}": F.count_if(F.array_contains(unreadable, c)) for c in columns}


def unreadable_report(counted: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    labelled = _by_label(counted, {c: f"unreadable_{c}" for c in columns}, "column_name", "unreadable_count")
    return labelled.select(F.lit(name).alias("table_name"), "column_name", "unreadable_count")


def unreadable_audit(df: DataFrame, columns: Sequence[str], unreadable: str, name: str) -> DataFrame:
    """Values per column that could not be converted when the extract was read."""
    return unreadable_report(_counted(df, unreadable_counts(columns, unreadable)), columns, name)


def _counted(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in counts.items()])


def _by_label(counted: DataFrame, figures: Mapping[str, str], label: str, out: str, *also: str) -> DataFrame:
    """One row per label with its figure, from one row of figures."""
    pairs = F.array(*[F.struct(F.lit(n).alias(label), F.col(c).alias(out)) for n, c in figures.items()])
    return counted.select(*also, F.inline(pairs))


def range_counts(limits: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    """Aggregates for :func:`range_report`; NULL and NaN are never outside."""
    return {
        f"outside_{c}": F.count_if(~F.isnan(F.col(c).cast("double")) & ((F.col(c) < low) | (F.col(c) > high)))
        for c, (low, high) in limits.items()
    }


def range_report(counted: DataFrame, limits: Mapping[str, tuple[float, float]], name: str) -> DataFrame:
    """Rows outside the closed interval of each column from one row of :func:`range_counts`."""
    bounds = F.create_map(
        *[x for c, (low, high) in limits.items() for x in (F.lit(c), F.array(F.lit(float(low)), F.lit(float(high))))]
    )
    return _by_label(counted, {c: f"outside_{c}" for c in limits}, "column_name", "out_of_range").select(
        F.lit(name).alias("table_name"),
        "column_name",
        bounds[F.col("column_name")][0].alias("min_allowed"),
        bounds[F.col("column_name")][1].alias("max_allowed"),
        "out_of_range",
    )


def range_audit(df: DataFrame, limits: Mapping[str, tuple[float, float]], name: str) -> DataFrame:
    """Rows outside the closed interval of each column, counted in one pass."""
    return range_report(_counted(df, range_counts(limits)), limits, name)


def order_rules() -> dict[str, Column]:
    return {
        "gmv_not_negative": F.col("gmv") >= 0,
        "discount_within_gmv": F.col("discount_amount") <= F.col("gmv"),
    }


def payment_rules() -> dict[str, Column]:
    return {
        "expected_payout_positive": F.col("expected_payout") > 0,
        "discrepancy_is_difference": F.round(F.col("expected_payout") - F.col("actual_payout"), 2)
        == F.col("discrepancy_amt"),
    }


def rule_counts(rules: Mapping[str, Column]) -> dict[str, Column]:
    """Aggregates for :func:`constraint_report`."""
    return {f"broken_{n}": F.count_if(~rule) for n, rule in rules.items()}


def constraint_report(counted: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return _by_label(counted, {n: f"broken_{n}" for n in rules}, "rule", "violations")


def constraint_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule, counted in one pass."""
    return constraint_report(_counted(df, rule_counts(rules)), rules)
