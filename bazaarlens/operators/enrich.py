"""Row-level enrichment of orders, payments and customers. No operator here shuffles,
except the seller lookup in :func:`expected_payouts`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import calendar
from bazaarlens.functions.numeric import MONEY, bands, ratio, rounded

# Labels and right-closed edges.
GMV_EDGES = (0, 500, 2000, 10000, 50000, None)
GMV_BANDS = ("<500", "500-2K", "2K-10K", "10K-50K", "50K+")
SEVERITY_EDGES = (-1, 0, 5, 15, 100)
SEVERITY_BANDS = ("none", "minor", "moderate", "critical")
TENURE_EDGES = (0, 30, 90, 180, 365, None)
TENURE_BANDS = ("<1M", "1-3M", "3-6M", "6-12M", "12M+")
DEFAULT_COMMISSION_PCT = 10


def net_revenue() -> Column:
    return F.round(F.col("gmv") - F.col("discount_amount") + F.col("shipping_fee"), 2).cast(MONEY)


def _positive_ratio(numerator: Column, denominator: Column, factor: int, digits: int) -> Column:
    value = rounded(ratio(numerator * F.lit(factor), denominator), digits).cast(f"decimal(18,{digits})")
    return F.when(denominator > 0, value).otherwise(F.lit(0).cast(f"decimal(18,{digits})"))


def enrich_orders(orders: DataFrame) -> DataFrame:
    """Time dimensions, status flags, net revenue, discount rate and order-value band."""
    day = F.col("order_date")
    flags = {f"is_{s}": (F.col("status") == s).cast("int") for s in ("returned", "cancelled", "delivered")}
    return orders.withColumns(
        {
            "net_revenue": F.col("net_revenue") if "net_revenue" in orders.columns else net_revenue(),
            "order_year": F.year(day),
            "order_month": F.month(day),
            "order_quarter": F.quarter(day),
            "order_week": calendar.iso_week(day),
            "order_dow": F.date_format(day, "EEEE"),
            "is_weekend": F.weekday(day) >= 5,
            **flags,
            "discount_rate": _positive_ratio(F.col("discount_amount"), F.col("gmv"), 1, 4),
            "gmv_band": bands(F.col("gmv"), GMV_EDGES, GMV_BANDS),
        }
    )


def derive_discrepancy(payments: DataFrame) -> DataFrame:
    """Shortfall, dispute flag, settlement status and cycle from the two payout amounts."""
    short = F.round(F.col("expected_payout") - F.col("actual_payout"), 2).cast(MONEY)
    return payments.withColumn("discrepancy_amt", short).withColumns(
        {
            "discrepancy_flag": (F.col("discrepancy_amt") != 0).cast("int"),
            "status": F.when(F.col("discrepancy_amt") != 0, "disputed").otherwise("settled"),
            "settlement_cycle": settlement_cycle(F.col("settlement_date")),
        }
    )


def settlement_cycle(day: Column) -> Column:
    return F.concat(F.lit("W"), calendar.iso_week(day).cast("string"))


def enrich_payments(payments: DataFrame) -> DataFrame:
    """Shortfall percentage (an incoming value is replaced) and its severity band."""
    pct = _positive_ratio(F.col("discrepancy_amt"), F.col("expected_payout"), 100, 2)
    return payments.withColumn("discrepancy_pct", pct).withColumn(
        "discrepancy_severity", bands(F.col("discrepancy_pct"), SEVERITY_EDGES, SEVERITY_BANDS)
    )


def enrich_customers(customers: DataFrame, as_of: str) -> DataFrame:
    """Whole days since registration at midnight of ``as_of``, and the tenure band."""
    days = calendar.whole_days_between(F.lit(as_of).cast("timestamp"), F.col("registration_date"))
    return customers.withColumn("days_since_reg", days).withColumn(
        "tenure_band", bands(F.col("days_since_reg"), TENURE_EDGES, TENURE_BANDS)
    )


def expected_payouts(orders: DataFrame, sellers: DataFrame) -> DataFrame:
    """Payout due for each delivered order; an unknown seller pays the default commission.

    No broadcast hint: AQE broadcasts the sellers when their measured size is small, and
    otherwise splits a hot seller's partition of the sort-merge join.
    """
    commission = sellers.select("seller_id", "commission_pct")
    rate = F.coalesce("commission_pct", F.lit(DEFAULT_COMMISSION_PCT).cast("decimal(5,2)"))
    payout = F.round(F.col("net_revenue") * (F.lit(100) - rate) * F.lit(0.01).cast("decimal(3,2)"), 2)
    return (
        orders.where("is_delivered = 1")
        .join(commission, "seller_id", "left")
        .select("order_id", "seller_id", "net_revenue", rate.alias("commission_pct"), payout.cast(MONEY).alias("expected_payout"))
    )
