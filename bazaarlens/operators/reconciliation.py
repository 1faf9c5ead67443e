"""Reconciliation report: the life of every payout, and an audit queue of sellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import calendar, ordered
from bazaarlens.functions.numeric import percent, rounded
from bazaarlens.functions.quantiles import exact_quantile
from bazaarlens.session import staged

# Thresholds and labels of the report.
AUDIT_QUANTILE = 0.75
REVIEW_RATE_PCT = 5
MANDATORY, REVIEW, CLEAN = "MANDATORY_AUDIT", "REVIEW_REQUIRED", "CLEAN"
CHRONIC, RECURRING, ISOLATED, SINGLE = (
    "Chronic (>6 months)",
    "Recurring (2-6 months)",
    "Isolated (<2 months)",
    "Single Event",
)


def _disputed() -> Column:
    return F.col("discrepancy_flag") == 1


def _paid_orders(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Delivered orders with their payout. Both inputs shuffle once on the unique order id,
    which cannot be skewed. Reports per seller aggregate this before they join sellers."""
    paid = payments.drop("seller_id").withColumnRenamed("status", "payment_status")
    return orders.where("is_delivered = 1").join(paid, "order_id")


def _seller_positions(paid: DataFrame) -> DataFrame:
    """Adds the running shortfall and the rank of each payout within its seller. ``paid`` is a
    written table, which is read for the sellers with very many payouts and their chunks, too."""
    amount = F.col("discrepancy_amt")
    undated = F.lit("0001-01-01").cast("date")
    # Sixteen classes per doubling, so even a seller whose payouts are all short is spread.
    magnitude = F.floor(F.log2(F.abs(amount.cast("double")) + 1) * 16) + 1
    signed = F.signum(amount.cast("double")) * F.when(amount == 0, 0).otherwise(magnitude)
    rows = paid.withColumns(
        {
            "_day": F.coalesce(F.col("settlement_date").cast("date"), undated),
            "_class": F.coalesce(signed.cast("int"), F.lit(-(10**6))),
        }
    ).withColumn("_zero_day", F.when(F.col("_class") == 0, F.col("_day")).otherwise(undated))
    large = ordered.large_keys(paid, ["seller_id"])
    placed = ordered.running_total(
        rows,
        keys=["seller_id"],
        chunk=["_day"],
        chunk_order=[F.col("_day")],
        order=[F.col("settlement_date"), F.col("payment_id")],
        value="discrepancy_amt",
        out="cumulative_discrepancy_by_seller",
        large=large,
    )
    return ordered.row_number(
        placed,
        keys=["seller_id"],
        chunk=["_class", "_zero_day"],
        chunk_order=[F.desc("_class"), F.asc("_zero_day")],
        order=[-F.col("discrepancy_amt"), F.col("settlement_date"), F.col("payment_id")],
        out="rank_within_seller",
        base=rows,
        large=large,
    )


def payment_audit_trail(orders: DataFrame, payments: DataFrame, sellers: DataFrame) -> DataFrame:
    """One row per settled order, with the seller's running shortfall, the settlement delay
    and the rank of the shortfall among the seller's payouts.

    Running total: by settlement date, then payment id. Rank: by shortfall from high to
    low, then settlement date and payment id. The payouts are joined with their orders
    once and written. One exchange by the seller then serves both windows and the join with
    the sellers. Only sellers with very many payouts are cut into chunks (settlement days;
    magnitude classes of the shortfall, and days among the many zero shortfalls) and large
    chunks once more, so that a seller with a large share of all payouts is spread over many
    tasks, whatever days and amounts these have.
    """
    named = sellers.select("seller_id", "seller_name", F.col("tier").alias("seller_tier"), "commission_pct")
    paid = _paid_orders(orders, payments).select(
        "order_id",
        "customer_id",
        "seller_id",
        "order_date",
        "gmv",
        "net_revenue",
        "category",
        "channel",
        "payment_id",
        "expected_payout",
        "actual_payout",
        "discrepancy_amt",
        "discrepancy_pct",
        "discrepancy_flag",
        "settlement_date",
        "settlement_cycle",
        "payment_status",
        "discrepancy_severity",
    )
    return (
        _seller_positions(staged(paid, "settled-payouts"))
        .join(named, "seller_id")
        .select(
            "order_id",
            "customer_id",
            "seller_id",
            "seller_name",
            "seller_tier",
            "commission_pct",
            "order_date",
            "gmv",
            "net_revenue",
            "category",
            "channel",
            "payment_id",
            "expected_payout",
            "actual_payout",
            "discrepancy_amt",
            "discrepancy_pct",
            "discrepancy_flag",
            "settlement_date",
            "settlement_cycle",
            "payment_status",
            "discrepancy_severity",
            calendar.days_between(F.col("settlement_date"), F.col("order_date")).alias("settlement_delay_days"),
            "cumulative_discrepancy_by_seller",
            "rank_within_seller",
        )
    )


def top_discrepancies_per_seller(
    orders: DataFrame, payments: DataFrame, sellers: DataFrame, n: int
) -> DataFrame:
    """The ``n`` largest shortfalls of each seller; every map task keeps ``n`` rows per seller,
    and only those meet the seller table."""
    order = Window.partitionBy("seller_id").orderBy(F.desc("discrepancy_amt"), "settlement_date", "payment_id")
    return (
        _paid_orders(orders, payments)
        .withColumn("rank_within_seller", F.row_number().over(order))
        .where(F.col("rank_within_seller") <= n)
        .join(sellers.select("seller_id", "seller_name"), "seller_id")
        .select("seller_id", "seller_name", "rank_within_seller", "payment_id", "order_id", "discrepancy_amt", "discrepancy_pct")
    )


def _seller_month_disputes(paid: DataFrame) -> DataFrame:
    """Seller totals per settlement month. The two-level aggregate spreads a large seller
    over its months and makes the distinct month count a plain sum."""
    shortfall = F.when(_disputed(), F.col("discrepancy_amt"))
    return paid.groupBy("seller_id", F.trunc("settlement_date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("payments"),
        F.sum("discrepancy_flag").alias("disputes"),
        F.sum(shortfall).alias("shortfall"),
        F.sum(F.when(_disputed(), F.col("discrepancy_pct"))).alias("pct_sum"),
        F.count(F.when(_disputed(), F.col("discrepancy_pct"))).alias("pct_count"),
        F.max("discrepancy_amt").alias("largest"),
        F.min("settlement_date").alias("earliest"),
        F.max("settlement_date").alias("latest"),
        F.min(F.when(_disputed(), F.col("settlement_date"))).alias("earliest_dispute"),
        F.max(F.when(_disputed(), F.col("settlement_date"))).alias("latest_dispute"),
    )


def _seller_summary(orders: DataFrame, payments: DataFrame, sellers: DataFrame) -> DataFrame:
    totals = payments.groupBy("seller_id").agg(
        F.sum(F.when(_disputed(), F.col("discrepancy_amt")).otherwise(0)).alias("total")
    )
    threshold = exact_quantile(totals, "total", AUDIT_QUANTILE).scalar()
    by_month = _seller_month_disputes(_paid_orders(orders, payments))
    named = sellers.select("seller_id", "seller_name", F.col("tier").alias("seller_tier"))
    rate = percent(F.sum("disputes"), F.sum("payments"))
    return (
        by_month.groupBy("seller_id")
        .agg(
            F.sum("payments").alias("total_payments"),
            F.sum("disputes").alias("disputed_count"),
            rate.alias("dispute_rate_pct"),
            F.coalesce(F.sum("shortfall"), F.lit(0)).cast("decimal(28,2)").alias("total_discrepancy_amt"),
            rounded(F.try_divide(F.sum("pct_sum").cast("double"), F.sum("pct_count")), 2).alias("avg_discrepancy_pct"),
            F.max("largest").alias("max_single_discrepancy"),
            F.min("earliest").alias("first_dispute_date"),
            F.max("latest").alias("latest_dispute_date"),
            F.min("earliest_dispute").alias("first_dispute"),
            F.max("latest_dispute").alias("last_dispute"),
            F.count_if((F.col("disputes") > 0) & F.col("month").isNotNull()).alias("months_with_disputes"),
        )
        .join(named, "seller_id")
        .withColumn(
            "audit_status",
            F.when(F.col("total_discrepancy_amt").cast("double") > threshold, MANDATORY)
            .when(F.col("dispute_rate_pct") > REVIEW_RATE_PCT, REVIEW)
            .otherwise(CLEAN),
        )
    )


def seller_discrepancy_summary(orders: DataFrame, payments: DataFrame, sellers: DataFrame) -> DataFrame:
    """Payout and dispute totals per seller, with the audit status.

    The two date columns span all payouts of the seller, disputed or not. The threshold is
    the exact quantile of dispute totals over all sellers with a payment record.
    """
    return _seller_summary(orders, payments, sellers).drop("first_dispute", "last_dispute")


def _cycle_totals(paid: DataFrame, sellers: DataFrame, *keys: Column) -> DataFrame:
    """Totals per cycle over payouts of known sellers, summed per seller before the seller join."""
    cycle = [f"_cycle{i}" for i in range(len(keys))]
    per_seller = paid.groupBy("seller_id", *[k.alias(c) for k, c in zip(keys, cycle)]).agg(
        F.count(F.lit(1)).alias("payments"),
        F.sum("discrepancy_flag").alias("disputes"),
        F.sum(F.when(_disputed(), F.col("discrepancy_amt")).otherwise(0)).alias("amt"),
    )
    return (
        per_seller.join(sellers.select("seller_id"), "seller_id")
        .groupBy(*cycle)
        .agg(
            F.sum("payments").alias("total_payments"),
            F.sum("disputes").alias("disputed_in_cycle"),
            percent(F.sum("disputes"), F.sum("payments")).alias("dispute_rate_pct"),
            F.sum("amt").cast("decimal(28,2)").alias("total_disc_amt"),
        )
    )


def _rate_change(order: list[str]) -> Column:
    # Runs over one row per settlement week, a few dozen per year of data.
    previous = F.lag("dispute_rate_pct").over(Window.orderBy(*order))
    return rounded(F.col("dispute_rate_pct") - previous, 2)


def settlement_cycle_anomalies(orders: DataFrame, payments: DataFrame, sellers: DataFrame) -> DataFrame:
    """Dispute rate per cycle label and its change; labels sort as text and pool all years."""
    totals = _cycle_totals(_paid_orders(orders, payments), sellers, F.col("settlement_cycle"))
    totals = totals.withColumnRenamed("_cycle0", "settlement_cycle")
    return totals.withColumn("dispute_rate_wow_change", _rate_change(["settlement_cycle"]))


def settlement_cycle_anomalies_chrono(orders: DataFrame, payments: DataFrame, sellers: DataFrame) -> DataFrame:
    """The same per ISO year and week, in time order."""
    day = F.col("settlement_date")
    totals = _cycle_totals(
        _paid_orders(orders, payments), sellers, calendar.iso_year(day), calendar.iso_week(day)
    ).withColumnsRenamed({"_cycle0": "settlement_year", "_cycle1": "settlement_week"})
    return totals.withColumn("dispute_rate_wow_change", _rate_change(["settlement_year", "settlement_week"]))


def dispute_timeline(orders: DataFrame, payments: DataFrame, sellers: DataFrame) -> DataFrame:
    """First and last dispute of each seller that has one. Payment ids are unique after the
    load, so counting disputed rows counts distinct payments."""
    return (
        _paid_orders(orders, payments)
        .where(_disputed())
        .groupBy("seller_id")
        .agg(
            F.min("settlement_date").alias("first_dispute"),
            F.max("settlement_date").alias("last_dispute"),
            calendar.days_between(F.max("settlement_date"), F.min("settlement_date")).alias("dispute_span_days"),
            F.count("payment_id").alias("dispute_events"),
        )
        .join(sellers.select("seller_id"), "seller_id")
    )


def reconciliation_report(orders: DataFrame, payments: DataFrame, sellers: DataFrame) -> DataFrame:
    """Disputed sellers with their pattern over time and a 0-100 triage score.

    The dispute dates come out of the same aggregate as the totals, so the joined payouts
    are read once and the summary needs no join with the timeline.
    """
    summary = _seller_summary(orders, payments, sellers).where("disputed_count > 0")
    summary = summary.withColumn(
        "dispute_span_days", calendar.days_between(F.col("last_dispute"), F.col("first_dispute"))
    )
    span = F.col("dispute_span_days")
    score = (
        F.col("total_discrepancy_amt").cast("double") / 10000 * 0.5
        + F.col("dispute_rate_pct") * 0.3
        + F.coalesce(span, F.lit(0.0)) / 365.0 * 20
    )
    return (
        summary.select(
            "seller_id",
            "seller_name",
            "seller_tier",
            "audit_status",
            "total_payments",
            "disputed_count",
            "dispute_rate_pct",
            "total_discrepancy_amt",
            "avg_discrepancy_pct",
            "max_single_discrepancy",
            "months_with_disputes",
            "first_dispute",
            "last_dispute",
            "dispute_span_days",
            F.when(span > 180, CHRONIC).when(span > 60, RECURRING).when(span > 0, ISOLATED).otherwise(SINGLE).alias("dispute_pattern"),
            rounded(F.least(F.lit(100.0), score), 1).alias("triage_priority_score"),
        )
        .orderBy(F.desc("triage_priority_score"), "seller_id")
    )
