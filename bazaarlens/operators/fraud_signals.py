"""Fraud report: velocity, return abuse, rapid repeats, escalation and the risk register."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import calendar
from bazaarlens.functions.numeric import mean, percent, rounded, with_totals

# Thresholds and labels of the report.
VELOCITY_Z = 3.0
RETURN_DAYS = 180
MIN_ORDERS = 20
REPEAT_HOURS = 12
REPEAT_MIN_GMV = 5000
# Orders of one slot that a task pairs with its first orders.
REPEAT_BLOCK = 512
HIGH_RISK, ELEVATED, NORMAL = "RETURN_ABUSE_HIGH_RISK", "RETURN_RATE_ELEVATED", "NORMAL"
ESCALATING, STABLE = "ESCALATING — INVESTIGATE", "STABLE"
CRITICAL_TIER = "🔴 CRITICAL — SUSPEND ACCOUNT"
HIGH_TIER = "🟡 HIGH — MANUAL REVIEW"
MONITOR_TIER = "🟢 MONITOR"
HIGH_VELOCITY = "HIGH_VELOCITY"


def weekly_seller_orders(orders: DataFrame) -> DataFrame:
    """Orders, value and returns per seller and calendar week. Weeks start on Monday and
    are cut at New Year; days before the first Monday are week 00."""
    day = F.col("order_date")
    return (
        orders.groupBy("seller_id", F.year(day).alias("_year"), calendar.monday_week_number(day).alias("_week"))
        .agg(
            F.count("order_id").alias("weekly_orders"),
            F.sum("gmv").alias("weekly_gmv"),
            F.sum("is_returned").alias("weekly_returns"),
        )
        .select(
            "seller_id",
            calendar.monday_week_label(F.col("_year"), F.col("_week")).alias("week"),
            "weekly_orders",
            "weekly_gmv",
            "weekly_returns",
            percent(F.col("weekly_returns"), F.col("weekly_orders")).alias("weekly_return_rate"),
        )
    )


def high_velocity(orders: DataFrame) -> DataFrame:
    """Seller weeks with more than three population deviations above the mean order count."""
    weekly = weekly_seller_orders(orders)
    n = F.col("weekly_orders")
    z = F.try_divide(n - F.col("_all.mu"), F.col("_all.sigma"))
    return (
        with_totals(weekly, weekly, mu=F.avg(n), sigma=F.stddev_pop(n))
        .withColumn("_z", z)
        .where(F.col("_z") > VELOCITY_Z)
        .select(
            "seller_id",
            "week",
            "weekly_orders",
            "weekly_gmv",
            "weekly_return_rate",
            rounded(F.col("_z"), 3).alias("z_score"),
            F.lit(HIGH_VELOCITY).alias("fraud_signal_type"),
        )
    )


def seller_return_profile(orders: DataFrame, as_of: str, days: int = RETURN_DAYS) -> DataFrame:
    """Sellers with at least twenty orders in the ``days`` before ``as_of``. The date filter
    is a plain comparison and reaches the scan of a date-partitioned table."""
    since = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
    return (
        orders.where(F.col("order_date") >= since)
        .groupBy("seller_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum("is_delivered").alias("delivered"),
            F.sum("is_returned").alias("returned"),
            percent(F.sum("is_returned"), F.count("order_id")).alias("return_rate_pct"),
            F.sum("gmv").alias("total_gmv"),
            rounded(mean(F.col("gmv")), 2).alias("avg_order_gmv"),
        )
        .where(F.col("total_orders") >= MIN_ORDERS)
    )


def return_anomaly(orders: DataFrame, as_of: str, days: int = RETURN_DAYS) -> DataFrame:
    """Sellers whose return rate exceeds 1.3 times the mean over sellers (each seller counts
    once, whatever its volume)."""
    profile = seller_return_profile(orders, as_of, days)
    rate, gmv = F.col("return_rate_pct"), F.col("total_gmv")
    # The rates have two decimals: averaging them as decimals makes the mean exact.
    profile = with_totals(
        profile,
        profile,
        rate=F.sum(rate.cast("decimal(18,2)")).cast("double") / F.nullif(F.count(rate), F.lit(0)),
        gmv=F.sum(gmv).cast("double") / F.nullif(F.count(gmv), F.lit(0)),
    )
    signal = (
        F.when((rate > 2 * F.col("_all.rate")) & (gmv.cast("double") > F.col("_all.gmv")), HIGH_RISK)
        .when(rate > 1.5 * F.col("_all.rate"), ELEVATED)
        .otherwise(NORMAL)
    )
    return profile.where(rate > 1.3 * F.col("_all.rate")).select(
        "seller_id", "total_orders", "return_rate_pct", "total_gmv", "avg_order_gmv", signal.alias("return_signal")
    )


def _slotted(orders: DataFrame, hours: int) -> DataFrame:
    slot = F.floor(F.unix_micros("order_date") / F.lit(float(hours * calendar.HOUR_MICROS)))
    return orders.withColumn("_slot", slot.cast("long"))


def rapid_repeat_orders(orders: DataFrame) -> DataFrame:
    """Pairs of orders of one customer at one seller, the second later by under 12 hours and
    the first worth more than 5000.

    Time is cut into one-hour slots; a repeat lies in the slot of the first order or one of
    the next twelve, so the range becomes an equality on seller, customer and slot plus a
    residual. Only the valuable first orders are looked up thirteen times, and only the first
    and last slot form pairs that are dropped. A busy pair is spread over its hours; the
    orders of a slot with very many are dealt into blocks, each of which all its first
    orders look up, so pairs of one hour are formed in many tasks.
    """
    slotted = _slotted(orders, 1)
    key = ["seller_id", "customer_id", "_slot"]
    busy = slotted.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / REPEAT_BLOCK).cast("int").alias("_blocks")).where("_blocks > 1")
    first = (
        slotted.where(F.col("gmv") > REPEAT_MIN_GMV)
        .select(
            "seller_id",
            "customer_id",
            F.col("order_id").alias("first_order_id"),
            F.col("order_date").alias("first_order_time"),
            F.col("gmv").alias("first_gmv"),
            F.explode(F.sequence(F.col("_slot"), F.col("_slot") + REPEAT_HOURS)).alias("_slot"),
        )
        .join(busy, key, "left")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
        .drop("_blocks")
    )
    second = slotted.join(busy, key, "left").select(
        "seller_id",
        "customer_id",
        F.col("order_id").alias("repeat_order_id"),
        F.col("order_date").alias("repeat_order_time"),
        F.col("gmv").alias("repeat_gmv"),
        "_slot",
        F.coalesce(F.pmod(F.xxhash64("order_id"), "_blocks"), F.lit(0)).cast("int").alias("_block"),
    )
    gap = calendar.micros_between(F.col("repeat_order_time"), F.col("first_order_time"))
    return (
        first.join(second, [*key, "_block"])
        .where((gap > 0) & (gap < REPEAT_HOURS * calendar.HOUR_MICROS) & (F.col("first_order_id") != F.col("repeat_order_id")))
        .select(
            "seller_id",
            "customer_id",
            "first_order_id",
            "repeat_order_id",
            "first_order_time",
            "repeat_order_time",
            rounded(gap.cast("double") / F.lit(float(calendar.HOUR_MICROS)), 2).alias("hours_between_orders"),
            "first_gmv",
            "repeat_gmv",
        )
    )


def rapid_repeat_counts(orders: DataFrame) -> DataFrame:
    """Per seller, the number of orders that :func:`rapid_repeat_orders` has as first order.

    No pairs are formed: an order is followed within 12 hours exactly if its own slot holds
    a later order, or the first order of the next slot is near enough. Both come from the
    first and last order time per slot. Order ids must be unique.
    """
    slotted = _slotted(orders, REPEAT_HOURS)
    slots = slotted.groupBy("seller_id", "customer_id", "_slot").agg(
        F.max("order_date").alias("last_here"), F.min("order_date").alias("first_here")
    )
    by_time = Window.partitionBy("seller_id", "customer_id").orderBy("_slot")
    adjacent = F.lead("_slot").over(by_time) == F.col("_slot") + 1
    following = slots.select(
        "seller_id",
        "customer_id",
        "_slot",
        "last_here",
        F.when(adjacent, F.lead("first_here").over(by_time)).alias("first_next"),
    )
    near = (
        calendar.micros_between(F.col("first_next"), F.col("order_date")) < REPEAT_HOURS * calendar.HOUR_MICROS
    )
    return (
        slotted.where(F.col("gmv") > REPEAT_MIN_GMV)
        .select("seller_id", "customer_id", "_slot", "order_date")
        .join(following, ["seller_id", "customer_id", "_slot"])
        .where((F.col("last_here") > F.col("order_date")) | near)
        .groupBy("seller_id")
        .agg(F.count(F.lit(1)).alias("rapid_repeat_order_events"))
    )


def monthly_dispute_trend(payments: DataFrame) -> DataFrame:
    """Disputes per seller and month, and the change from the seller's previous month that
    had any. The window runs over one row per month of a seller."""
    months = Window.partitionBy("seller_id").orderBy("settlement_month")
    return (
        payments.where("discrepancy_flag = 1")
        .groupBy("seller_id", F.date_format("settlement_date", "yyyy-MM").alias("settlement_month"))
        .agg(
            F.count(F.lit(1)).alias("payments"),
            F.sum("discrepancy_flag").alias("disputes"),
            F.sum("discrepancy_amt").alias("disc_amt"),
        )
        .withColumn("disc_amt_mom_change", F.col("disc_amt") - F.lag("disc_amt").over(months))
    )


def escalating_sellers(payments: DataFrame) -> DataFrame:
    """Sellers with disputes in at least three months; escalating when the amount rose in
    more than 60% of the steps. Months are distinct already, so they are simply counted."""
    increases = F.count_if(F.col("disc_amt_mom_change") > 0)
    steps = F.count("settlement_month") - 1
    return (
        monthly_dispute_trend(payments)
        .groupBy("seller_id")
        .agg(
            F.count("settlement_month").alias("months_with_disputes"),
            F.sum("disputes").alias("total_disputes"),
            F.sum("disc_amt").alias("total_disc_amt"),
            increases.alias("months_with_increase"),
            F.when(F.try_divide(increases.cast("double"), steps) > 0.6, ESCALATING).otherwise(STABLE).alias("escalation_status"),
        )
        .where("months_with_disputes >= 3")
    )


def fraud_risk_register(orders: DataFrame, payments: DataFrame, repeat_source: DataFrame, as_of: str) -> DataFrame:
    """Sellers with abnormal returns, their escalation and rapid repeats, and a risk tier.

    ``repeat_source`` are the orders searched for rapid repeats. Every input is reduced to
    one row per seller before the joins.
    """
    returns = return_anomaly(orders, as_of).select("seller_id", "return_rate_pct", "total_gmv", "return_signal")
    escalation = escalating_sellers(payments).select(
        "seller_id", "escalation_status", "total_disc_amt", "months_with_disputes"
    )
    repeats = rapid_repeat_counts(repeat_source)
    signal, escalates = F.col("return_signal"), F.col("escalation_status") == ESCALATING
    tier = (
        F.when((signal == HIGH_RISK) & escalates, CRITICAL_TIER)
        .when(signal.isin(HIGH_RISK, ELEVATED) | escalates, HIGH_TIER)
        .otherwise(MONITOR_TIER)
    )
    rank = F.when(F.col("risk_tier") == CRITICAL_TIER, 1).when(F.col("risk_tier") == HIGH_TIER, 2).otherwise(3)
    return (
        returns.join(escalation, "seller_id", "left")
        .join(repeats, "seller_id", "left")
        .select(
            "seller_id",
            "return_rate_pct",
            "total_gmv",
            "return_signal",
            "escalation_status",
            "total_disc_amt",
            "months_with_disputes",
            F.coalesce("rapid_repeat_order_events", F.lit(0)).alias("rapid_repeat_order_events"),
            tier.alias("risk_tier"),
        )
        .orderBy(rank, F.desc("total_gmv"), "seller_id")
    )
