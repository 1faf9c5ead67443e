"""Cohorts by month of the first delivered order: retention and lifetime value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import calendar
from bazaarlens.functions.numeric import ratio, rounded, with_totals

LAST_PERIOD = 11
PERIODS = list(range(LAST_PERIOD + 1))
MIN_OBSERVED_MONTHS = 6


def _delivered_months(orders: DataFrame) -> DataFrame:
    """Delivered orders of known customers; one without a customer belongs to no cohort."""
    return orders.where("is_delivered = 1 AND customer_id IS NOT NULL").withColumn("_month", calendar.month_index(F.col("order_date")))


def cohort_activity(orders: DataFrame) -> DataFrame:
    """Delivered orders of a customer's first twelve months, with cohort and period.

    The first month is aggregated per customer and joined back. A window over the customer
    would put all orders of one customer in one task; AQE can split the join instead.
    """
    delivered = _delivered_months(orders)
    first = delivered.groupBy("customer_id").agg(F.min("_month").alias("_first"))
    return (
        delivered.join(first, "customer_id")
        .withColumn("period_number", F.col("_month") - F.col("_first"))
        .where(F.col("period_number") <= LAST_PERIOD)
        .select(
            "order_id",
            "customer_id",
            calendar.month_label(F.col("_month")).alias("order_month"),
            calendar.month_label(F.col("_first")).alias("cohort_month"),
            "period_number",
            "net_revenue",
        )
    )


def _customer_periods(orders: DataFrame) -> DataFrame:
    """One row per customer and active month within a year of the first. Orders collapse to
    months on the map side, so the window over a customer sees at most one row per month."""
    monthly = (
        _delivered_months(orders).groupBy("customer_id", "_month").agg(F.sum("net_revenue").alias("revenue"))
    )
    first = F.min("_month").over(Window.partitionBy("customer_id"))
    return (
        monthly.withColumn("cohort", first)
        .withColumn("period_number", F.col("_month") - F.col("cohort"))
        .where(F.col("period_number") <= LAST_PERIOD)
    )


def _cohort_periods(orders: DataFrame) -> DataFrame:
    """Active customers and revenue per cohort and period; a few hundred rows at most.
    Each customer occurs once per period, so counting rows counts distinct customers."""
    return (
        _customer_periods(orders)
        .groupBy("cohort", "period_number")
        .agg(F.count("customer_id").alias("active_users"), F.sum("revenue").alias("revenue"))
    )


def cohort_active_users(orders: DataFrame) -> DataFrame:
    """Active customers per cohort and period beside the cohort size (period 0)."""
    size = F.max(F.when(F.col("period_number") == 0, F.col("active_users"))).over(Window.partitionBy("cohort"))
    return _cohort_periods(orders).select(
        calendar.month_label(F.col("cohort")).alias("cohort_month"),
        "period_number",
        "active_users",
        size.alias("cohort_size"),
    )


def _wide(periods: DataFrame, value: str) -> DataFrame:
    """Cohorts as rows, periods 0..11 as columns ``0``..``11``, plus the cohort size."""
    sizes = F.sum(F.when(F.col("period_number") == 0, F.col("active_users"))).alias("size")
    cells = [F.sum(F.when(F.col("period_number") == k, F.col(value))).alias(str(k)) for k in PERIODS]
    return periods.groupBy("cohort").agg(sizes, *cells)


def cohort_retention_matrix(orders: DataFrame) -> DataFrame:
    """Share of the cohort active in each period; a period without activity stays NULL."""
    return (
        _wide(_cohort_periods(orders), "active_users")
        .select(
            calendar.month_label(F.col("cohort")).alias("cohort_month"),
            *[rounded(ratio(F.col(str(k)), F.col("size")), 4).alias(f"m{k}") for k in PERIODS],
        )
        .orderBy("cohort_month")
    )


def _ltv_cells(orders: DataFrame) -> DataFrame:
    """Cumulative revenue per customer of the cohort; a missing month adds nothing.

    A period that no cohort has reached is NULL throughout. The running sum is an
    expression over the twelve columns, so no grid of cohorts and periods is built.
    """
    wide = _wide(_cohort_periods(orders), "revenue")
    everything = Window.partitionBy()
    cells: list[Column] = []
    total = None
    for k in PERIODS:
        month = F.coalesce(F.col(str(k)), F.lit(0).cast("decimal(38,2)"))
        total = month if total is None else total + month
        reached = F.count(str(k)).over(everything) > 0
        cells.append(F.when(reached, rounded(ratio(total, F.col("size")), 2)).alias(f"m{k}"))
    return wide.select("cohort", *cells)


def cohort_ltv_matrix(orders: DataFrame) -> DataFrame:
    """Cumulative lifetime value; months after the end of the data repeat the last value."""
    return (
        _ltv_cells(orders)
        .select(calendar.month_label(F.col("cohort")).alias("cohort_month"), *[f"m{k}" for k in PERIODS])
        .orderBy("cohort_month")
    )


def cohort_ltv_observed(orders: DataFrame) -> DataFrame:
    """Lifetime value of observed months only, for cohorts with at least six of them."""
    observed = F.col("_all.month") - F.col("cohort")
    return (
        with_totals(_ltv_cells(orders), _delivered_months(orders), month=F.max("_month"))
        .where(observed + 1 >= MIN_OBSERVED_MONTHS)
        .select(
            calendar.month_label(F.col("cohort")).alias("cohort_month"),
            F.least(observed + 1, F.lit(LAST_PERIOD + 1)).alias("observed_months"),
            *[F.when(F.lit(k) <= observed, F.col(f"m{k}")).alias(f"m{k}") for k in PERIODS],
        )
        .orderBy("cohort_month")
    )


def cohort_report(orders: DataFrame) -> DataFrame:
    """Mean retention after 1, 3 and 6 months, best and worst cohort after one month (the
    earlier cohort on a tie), and mean lifetime value at month 6."""
    retention = cohort_retention_matrix(orders)
    kept = F.col("m1").isNotNull()
    best = F.min_by("cohort_month", F.when(kept, F.struct(-F.col("m1"), F.col("cohort_month"))))
    worst = F.min_by("cohort_month", F.when(kept, F.struct(F.col("m1"), F.col("cohort_month"))))
    value = cohort_ltv_matrix(orders).agg(F.avg("m6")).scalar()
    return retention.agg(
        *[rounded(F.avg(f"m{k}") * 100, 1).alias(f"avg_m{k}_retention_pct") for k in (1, 3, 6)],
        best.alias("best_m1_cohort"),
        rounded(F.max("m1") * 100, 1).alias("best_m1_pct"),
        worst.alias("worst_m1_cohort"),
        rounded(F.min("m1") * 100, 1).alias("worst_m1_pct"),
    ).withColumn("avg_6m_ltv", rounded(value, 2))
