"""Every operator as a named report over one directory of star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions.numeric import rounded
from bazaarlens.operators import (
    anomalies,
    attribution,
    channel_roi,
    cohorts,
    enrich,
    experiments,
    fraud_signals,
    payout_risk,
    quality,
    reconciliation,
    summaries,
)
from bazaarlens.plans import etl
from bazaarlens.session import shared_folder
from bazaarlens.sources import sinks
from bazaarlens.sources.star_schema import StarSchemaTables

# Reference days of the reports; "today" is always a parameter.
RETURNS_AS_OF = "2001-08-01"
TENURE_AS_OF = "2001-06-30"
TOP_SELLERS = 15
TOP_PER_SELLER = 3

Tables = StarSchemaTables


def _round_columns(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: rounded(F.col(name), n) for name, n in digits.items()})


def _settled(operator: Callable[..., DataFrame]) -> Callable[[Tables], DataFrame]:
    return lambda t: operator(t.orders(), t.payments(), t.sellers())


def _clean_roundtrip(t: Tables) -> DataFrame:
    # A fresh path for each call: frames returned earlier still read theirs.
    path = f"{shared_folder(t.spark)}/payments_clean-{uuid.uuid4().hex}"
    sinks.write_clean(t.payments(), path, "settlement_date", ("seller_id",))
    return t.spark.read.parquet(path).drop("settlement_date_month")


def _duplicates(t: Tables) -> DataFrame:
    return quality.duplicate_audit(t.raw_lines(), ["l_orderkey", "l_linenumber"], "orders")


def _nulls(t: Tables) -> DataFrame:
    orders = quality.null_audit(t.raw_orders(), etl.CRITICAL["orders"], "orders")
    return orders.union(quality.null_audit(t.payments(), etl.CRITICAL["payments"], "payments"))


def _constraints(t: Tables) -> DataFrame:
    orders = quality.constraint_audit(t.raw_orders(), quality.order_rules())
    return orders.union(quality.constraint_audit(t.payments(), quality.payment_rules()))


REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    # Quality and load
    "dedup_orders": lambda t: t.raw_orders(),
    "duplicate_audit": _duplicates,
    "null_audit": _nulls,
    "range_audit": lambda t: quality.range_audit(t.orders(), etl.ORDER_RANGES, "orders"),
    "constraint_audit": _constraints,
    "clean_roundtrip": _clean_roundtrip,
    "orders_enriched": lambda t: t.orders(),
    "payments_enriched": lambda t: t.payments(),
    "customers_enriched": lambda t: enrich.enrich_customers(t.customers(), TENURE_AS_OF),
    "expected_payouts": lambda t: enrich.expected_payouts(t.orders(), t.sellers()),
    "payout_discrepancies": lambda t: enrich.derive_discrepancy(t.raw_payments()),
    # Summaries
    "monthly_revenue_summary": lambda t: summaries.monthly_revenue_summary(t.orders()),
    "seller_performance": lambda t: summaries.seller_performance(t.orders()),
    "discrepancy_summary": lambda t: summaries.discrepancy_summary(t.payments()),
    # Reconciliation report
    "payment_audit_trail": lambda t: _round_columns(
        _settled(reconciliation.payment_audit_trail)(t), settlement_delay_days=6
    ),
    "top_discrepancies_per_seller": lambda t: reconciliation.top_discrepancies_per_seller(
        t.orders(), t.payments(), t.sellers(), TOP_PER_SELLER
    ),
    "seller_discrepancy_summary": _settled(reconciliation.seller_discrepancy_summary),
    "settlement_cycle_anomalies": _settled(reconciliation.settlement_cycle_anomalies),
    "settlement_cycle_anomalies_chrono": _settled(reconciliation.settlement_cycle_anomalies_chrono),
    "dispute_timeline": _settled(reconciliation.dispute_timeline),
    "reconciliation_report": _settled(reconciliation.reconciliation_report),
    # Payout risk
    "disputed_payments": lambda t: payout_risk.disputed_payments(t.payments()),
    "seller_audit_list": lambda t: payout_risk.seller_audit_list(t.payments(), t.sellers()),
    "severity_breakdown": lambda t: payout_risk.severity_breakdown(t.payments()),
    "monthly_discrepancy_trend": lambda t: payout_risk.monthly_discrepancy_trend(t.payments()),
    "top_risk_sellers": lambda t: payout_risk.top_risk_sellers(t.payments(), t.sellers(), TOP_SELLERS),
    "discrepancy_pct_histogram": lambda t: _round_columns(
        payout_risk.discrepancy_pct_histogram(t.payments()), bin_start=6, bin_end=6, median_pct=4
    ),
    "reconciliation_totals": lambda t: payout_risk.reconciliation_totals(t.payments()),
    # Marketing report
    "channel_revenue": lambda t: _round_columns(attribution.channel_revenue(t.orders()), avg_order_value=4),
    "monthly_channel_trend": lambda t: attribution.monthly_channel_trend(t.orders()),
    "acquisition_ltv": lambda t: attribution.acquisition_ltv(t.customers(), t.orders()),
    "order_sequence": lambda t: attribution.order_sequence(t.orders()),
    "new_vs_returning": lambda t: attribution.new_vs_returning(t.orders()),
    "channel_scorecard": lambda t: attribution.channel_scorecard(t.orders(), t.customers()),
    # Marketing ROI
    "channel_roi": lambda t: _round_columns(
        channel_roi.channel_roi(t.orders(), t.marketing_spend()), avg_order_value=4
    ),
    "weekly_channel_revenue": lambda t: channel_roi.weekly_channel_revenue(t.orders()),
    "top_channel_weekly_trend": lambda t: channel_roi.top_channel_weekly_trend(t.orders(), t.marketing_spend()),
    "roi_recommendation": lambda t: channel_roi.roi_recommendation(t.orders(), t.marketing_spend()),
    "channel_scorecard_text": lambda t: channel_roi.channel_scorecard_text(t.orders(), t.marketing_spend()),
    # Cohorts
    "cohort_activity": lambda t: cohorts.cohort_activity(t.orders()),
    "cohort_active_users": lambda t: cohorts.cohort_active_users(t.orders()),
    "cohort_retention_matrix": lambda t: cohorts.cohort_retention_matrix(t.orders()),
    "cohort_ltv_matrix": lambda t: cohorts.cohort_ltv_matrix(t.orders()),
    "cohort_ltv_observed": lambda t: cohorts.cohort_ltv_observed(t.orders()),
    "cohort_report": lambda t: cohorts.cohort_report(t.orders()),
    # Experiments
    "ab_arm_counts": lambda t: experiments.ab_arm_counts(t.sessions()),
    "ab_test_result": lambda t: experiments.ab_test_result(t.sessions()),
    "ab_segment_results": lambda t: experiments.ab_segment_results(t.sessions()),
    "ab_daily_rolling_conversion": lambda t: experiments.ab_daily_rolling_conversion(t.sessions()),
    "ab_required_sample": lambda t: experiments.ab_required_sample(t.sessions()),
    "ab_observed_power": lambda t: experiments.ab_observed_power(t.sessions()),
    "ab_power_curve": lambda t: experiments.ab_power_curve(t.sessions()),
    # Fraud report
    "weekly_seller_orders": lambda t: fraud_signals.weekly_seller_orders(t.orders()),
    "high_velocity_sql": lambda t: fraud_signals.high_velocity(t.orders()),
    "seller_return_profile": lambda t: fraud_signals.seller_return_profile(t.orders(), RETURNS_AS_OF),
    "return_anomaly": lambda t: fraud_signals.return_anomaly(t.orders(), RETURNS_AS_OF),
    "rapid_repeat_orders": lambda t: fraud_signals.rapid_repeat_orders(t.purchases()),
    "rapid_repeat_counts": lambda t: fraud_signals.rapid_repeat_counts(t.purchases()),
    "monthly_dispute_trend": lambda t: fraud_signals.monthly_dispute_trend(t.payments()),
    "escalating_sellers": lambda t: fraud_signals.escalating_sellers(t.payments()),
    "fraud_risk_register": lambda t: fraud_signals.fraud_risk_register(
        t.orders(), t.payments(), t.purchases(), RETURNS_AS_OF
    ),
    # Anomalies
    "high_velocity_sellers": lambda t: _round_columns(
        anomalies.high_velocity_sellers(t.orders()), order_z=6, gmv_z=6, combined_z=6
    ),
    "refund_anomalies": lambda t: _round_columns(
        anomalies.refund_anomalies(t.orders()), return_rate=6, return_rate_z=6, gmv_z=6
    ),
    "gmv_spikes": lambda t: _round_columns(
        anomalies.gmv_spikes(t.orders()), rolling_mean=2, rolling_std=2, z_score=5
    ),
    "fraud_score_histogram": lambda t: _round_columns(
        anomalies.fraud_score_histogram(t.orders()), bin_start=6, bin_end=6, p95_score=6
    ),
    "top_velocity_sellers": lambda t: _round_columns(
        anomalies.top_velocity_sellers(t.orders()), order_z=6, gmv_z=6, combined_z=6
    ),
    "anomaly_summary": lambda t: anomalies.anomaly_summary(t.orders()),
}


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, whole numbers as bigint and dates as text, so that a result
    compares with another engine's whatever numeric type that one derived."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def run(name: str, spark: SparkSession, directory: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return portable(REPORTS[name](StarSchemaTables(spark, directory)))
