"""Payout risk: scored disputes, sellers to audit and the figures behind the overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.numeric import band_order, bands, mean, percent, ratio, rounded, with_totals
from bazaarlens.functions.quantiles import equal_width_histogram, exact_quantile

# Labels, edges, weights and thresholds.
TIER_EDGES = (-1, 5, 15, 30, 100)
TIERS = ("Minor (<5%)", "Moderate (5-15%)", "High (15-30%)", "Critical (>30%)")
AMOUNT_WEIGHT, PCT_WEIGHT = 0.6, 0.4
AUDIT_QUANTILE = 0.80
RED_RISK = 0.7
HISTOGRAM_BINS = 40


def disputed_payments(payments: DataFrame) -> DataFrame:
    """Disputes with a 0-1 risk score relative to the largest amount and percentage.

    The two maxima are one scalar subquery. Highest risk first; an aggregate over the
    result drops the sort from its plan.
    """
    disputed = payments.where("discrepancy_flag = 1")
    scored = with_totals(disputed, disputed, amt=F.max("discrepancy_amt"), pct=F.max("discrepancy_pct"))
    score = F.lit(AMOUNT_WEIGHT) * ratio(F.col("discrepancy_amt"), F.col("_all.amt")) + F.lit(PCT_WEIGHT) * ratio(
        F.col("discrepancy_pct"), F.col("_all.pct")
    )
    return (
        scored.withColumns(
            {
                "risk_score": rounded(score, 4),
                "severity_tier": bands(F.col("discrepancy_pct"), TIER_EDGES, TIERS),
            }
        )
        .drop("_all")
        .orderBy(F.desc("risk_score"), "payment_id")
    )


def seller_audit_list(payments: DataFrame, sellers: DataFrame) -> DataFrame:
    """Dispute totals per seller; the upper fifth of the totals must be audited.

    Aggregates are rounded before the threshold is taken, and the threshold is inclusive.
    The totals are one struct, which no use prunes, so the list and the threshold share
    one aggregation.
    """
    measures = F.struct(
        F.count("payment_id").alias("disputed_count"),
        F.sum("discrepancy_amt").alias("total_discrepancy"),
        rounded(mean(F.col("discrepancy_pct")), 2).alias("avg_discrepancy_pct"),
        rounded(F.max("risk_score"), 2).alias("max_risk_score"),
    )
    totals = disputed_payments(payments).groupBy("seller_id").agg(measures.alias("m"))
    threshold = exact_quantile(totals, "m.total_discrepancy", AUDIT_QUANTILE).scalar()
    return (
        totals.select("seller_id", "m.*")
        .join(sellers.select("seller_id", "seller_name", "category", "tier"), "seller_id", "left")
        .withColumn("audit_required", F.col("total_discrepancy").cast("double") >= threshold)
        .orderBy(F.desc("total_discrepancy"), "seller_id")
    )


def severity_breakdown(payments: DataFrame) -> DataFrame:
    tier = bands(F.col("discrepancy_pct"), TIER_EDGES, TIERS)
    return (
        payments.where("discrepancy_flag = 1")
        .groupBy(tier.alias("severity_tier"))
        .agg(F.count(F.lit(1)).alias("cases"), F.sum("discrepancy_amt").alias("total_discrepancy"))
        .where(F.col("severity_tier").isNotNull())
        .withColumn("tier_order", band_order(F.col("severity_tier"), TIERS))
        .orderBy("tier_order")
    )


def monthly_discrepancy_trend(payments: DataFrame) -> DataFrame:
    return (
        payments.where("discrepancy_flag = 1")
        .groupBy(F.trunc("settlement_date", "month").alias("month"))
        .agg(F.sum("discrepancy_amt").alias("discrepancy_amt"))
        .orderBy("month")
    )


def top_risk_sellers(payments: DataFrame, sellers: DataFrame, n: int) -> DataFrame:
    """The ``n`` sellers with the largest totals, red above a risk of 0.7 and amber otherwise."""
    return (
        seller_audit_list(payments, sellers)
        .select("seller_id", "seller_name", "disputed_count", "total_discrepancy", "max_risk_score", "audit_required")
        .withColumn("risk_flag", F.when(F.col("max_risk_score") > RED_RISK, "🔴").otherwise("🟡"))
        .orderBy(F.desc("total_discrepancy"), "seller_id")
        .limit(n)
    )


def discrepancy_pct_histogram(payments: DataFrame) -> DataFrame:
    """Forty equal bins of the shortfall percentage, and its median."""
    disputed = payments.where("discrepancy_flag = 1")
    median = exact_quantile(disputed, "discrepancy_pct", 0.5).scalar()
    return equal_width_histogram(disputed, "discrepancy_pct", HISTOGRAM_BINS, digits=2).withColumn("median_pct", median)


def reconciliation_totals(payments: DataFrame) -> DataFrame:
    """Payout totals, share of disputed payments and number of sellers to audit, as one row."""
    disputed = F.col("discrepancy_flag") == 1
    sums = payments.where(disputed).groupBy("seller_id").agg(F.sum("discrepancy_amt").alias("total"))
    threshold = exact_quantile(sums, "total", AUDIT_QUANTILE).scalar()
    audited = sums.agg(F.count_if(F.col("total").cast("double") >= threshold)).scalar()
    return payments.agg(
        F.count(F.lit(1)).alias("total_payments"),
        F.sum("expected_payout").alias("total_expected"),
        F.sum("actual_payout").alias("total_actual"),
        F.coalesce(F.sum(F.when(disputed, F.col("discrepancy_amt"))), F.lit(0)).cast("decimal(28,2)").alias("total_discrepancy"),
        F.coalesce(percent(F.count_if(disputed), F.count(F.lit(1))), F.lit(0.0)).alias("discrepancy_rate_pct"),
    ).withColumn("sellers_flagged", audited)
