from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import enrich, quality, summaries
from helpers import by, money, orders, payments, sellers, when


@pytest.fixture(scope="module")
def four_orders(spark):
    return orders(
        spark,
        [
            {"order_id": "ORD001", "gmv": 12000, "discount_amount": 1200, "shipping_fee": 50, "status": "delivered"},
            {"order_id": "ORD002", "gmv": 3500, "discount_amount": 350, "shipping_fee": 30, "status": "delivered"},
            {"order_id": "ORD003", "gmv": 8000, "discount_amount": 0, "status": "returned"},
            {"order_id": "ORD004", "gmv": 1200, "discount_amount": 60, "status": "delivered"},
        ],
    )


def test_orders_enriched(four_orders):
    rows = by(enrich.enrich_orders(four_orders), "order_id")
    assert len(rows) == 4
    first = rows["ORD001"]
    assert (first.order_year, first.order_month, first.order_quarter, first.order_week) == (2024, 1, 1, 3)
    assert (first.order_dow, first.is_weekend) == ("Monday", False)
    assert (first.is_delivered, rows["ORD003"].is_returned, rows["ORD003"].is_delivered) == (1, 1, 0)
    assert float(first.discount_rate) == 0.1
    assert all(0 <= r.discount_rate <= 1 for r in rows.values())
    assert first.net_revenue == money(10850)


def test_weekend(spark):
    df = enrich.enrich_orders(orders(spark, [{"order_date": f"2024-01-{d} 23:59:59"} for d in (19, 20, 21, 22)]))
    assert [r.is_weekend for r in df.orderBy("order_date").collect()] == [False, True, True, False]


@pytest.mark.parametrize(
    "gmv,band",
    [(0, None), (-1, None), (0.01, "<500"), (500, "<500"), (500.01, "500-2K"), (2000, "500-2K"), (10000, "2K-10K"), (50000, "10K-50K"), (50000.01, "50K+")],
)
def test_gmv_bands_are_right_closed(spark, gmv, band):
    row = enrich.enrich_orders(orders(spark, [{"gmv": gmv}])).first()
    assert row.gmv_band == band
    if gmv <= 0:
        assert float(row.discount_rate) == 0


@pytest.mark.parametrize(
    "expected,actual,pct,severity",
    [
        (100, 100, 0, "none"), (100, 99.99, 0.01, "minor"), (100, 95, 5, "minor"), (100, 85, 15, "moderate"),
        (100, 0, 100, "critical"), (100, -0.01, 100.01, None), (100, 101, -1, None), (100, 100.99, -0.99, "none"), (0, 5, 0, "none"),
    ],
)
def test_discrepancy_severity(spark, expected, actual, pct, severity):
    row = enrich.enrich_payments(payments(spark, [{"expected_payout": expected, "actual_payout": actual}])).first()
    assert float(row.discrepancy_pct) == pytest.approx(pct)
    assert row.discrepancy_severity == severity


def test_incoming_percentage_is_replaced(spark):
    df = payments(spark, [{"expected_payout": 2924.10, "actual_payout": 2000}]).withColumn("discrepancy_pct", F.lit(77.0))
    assert float(enrich.enrich_payments(df).first().discrepancy_pct) == 31.60


def test_discrepancy_is_derived(spark):
    raw = payments(spark, [{"expected_payout": 9720, "actual_payout": 9720}, {"expected_payout": 2924.10, "actual_payout": 2000, "settlement_date": "2024-02-08 00:00:00"}])
    rows = by(enrich.derive_discrepancy(raw.drop("discrepancy_amt", "discrepancy_flag", "status", "settlement_cycle")), "payment_id")
    assert (rows["P00000"].discrepancy_flag, rows["P00000"].status, rows["P00000"].settlement_cycle) == (0, "settled", "W4")
    assert (rows["P00001"].discrepancy_amt, rows["P00001"].status, rows["P00001"].settlement_cycle) == (money(924.10), "disputed", "W6")


@pytest.mark.parametrize(
    "registered,days,band",
    [
        ("2024-06-30 00:00:00", 0, None), ("2024-07-01 00:00:00", -1, None), ("2024-06-30 00:00:01", -1, None), ("2024-06-28 23:00:00", 1, "<1M"),
        ("2024-06-29 00:00:01", 0, None), ("2024-05-31 00:00:00", 30, "<1M"), ("2024-05-30 00:00:00", 31, "1-3M"), ("2020-01-01 00:00:00", 1642, "12M+"),
    ],
)
def test_tenure_is_floored(spark, registered, days, band):
    df = spark.createDataFrame([(when(registered),)], "registration_date timestamp")
    row = enrich.enrich_customers(df, "2024-06-30").first()
    assert (row.days_since_reg, row.tenure_band) == (days, band)


def test_unknown_seller_pays_default_commission(spark):
    clean = enrich.enrich_orders(orders(spark, [{"seller_id": "S1", "gmv": 200}, {"seller_id": "S9", "gmv": 300}, {"status": "pending"}]))
    known = sellers(spark, ["S1"]).withColumn("commission_pct", F.lit(25).cast("decimal(5,2)"))
    rows = by(enrich.expected_payouts(clean, known), "seller_id")
    assert rows["S1"].expected_payout == money(150) and rows["S9"].expected_payout == money(270)


def test_dedup_keeps_one_row_per_key_and_is_stable(spark, four_orders):
    doubled = four_orders.union(four_orders.limit(1)).repartition(3)
    assert quality.drop_duplicate_keys(doubled, ["order_id"], ["order_date"]).count() == 4
    copies = spark.createDataFrame([("a", 3, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 2, "w")], "k string, t int, v string")
    rows = by(quality.drop_duplicate_keys(copies.repartition(4), ["k"], ["t"]), "k")
    assert rows["a"].v == "y" and rows["b"].v == "w"


def test_dedup_limits_rows_before_the_shuffle(spark):
    """A hot key must not send its copies over the network."""
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    plan = quality.drop_duplicate_keys(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange")
    assert "Partial" in plan[exchange:] and "WindowGroupLimit" in plan[exchange:]


def test_duplicate_audit(spark, four_orders):
    row = quality.duplicate_audit(four_orders.union(four_orders), ["order_id"], "orders").first()
    assert (row.row_count, row.distinct_keys, row.duplicate_rows) == (8, 4, 4)


def test_null_audit_counts_and_shares(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (None, None)], "a int, b string")
    rows = by(quality.null_audit(df, ["a", "b"], "t"), "column_name")
    assert (rows["a"].null_count, rows["a"].null_share) == (1, 0.3333)
    assert (rows["b"].null_count, rows["b"].null_share) == (2, 0.6667)
    assert by(quality.null_audit(df.limit(0), ["a"], "t"), "column_name")["a"].null_share == 0


def test_range_audit_is_inclusive_and_ignores_nan(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.01,), (-0.01,), (float("nan"),), (None,)], "x double")
    assert quality.range_audit(df, {"x": (0, 1)}, "t").first().out_of_range == 2


def test_constraints(spark, four_orders):
    bad = four_orders.withColumn("discount_amount", F.when(F.col("order_id") == "ORD002", 99999).otherwise(F.col("discount_amount")))
    assert [r.violations for r in quality.constraint_audit(four_orders, quality.order_rules()).collect()] == [0, 0]
    rows = by(quality.constraint_audit(bad, quality.order_rules()), "rule")
    assert rows["discount_within_gmv"].violations == 1
    pay = payments(spark, [{"expected_payout": 0, "actual_payout": 0}, {"actual_payout": 90}])
    assert by(quality.constraint_audit(pay, quality.payment_rules()), "rule")["expected_payout_positive"].violations == 1


def test_summaries(four_orders, spark):
    clean = enrich.enrich_orders(four_orders)
    month = summaries.monthly_revenue_summary(clean).first()
    assert (month.total_orders, month.total_gmv, month.avg_order_value) == (3, money(16700), 5566.67)
    seller = summaries.seller_performance(clean).first()
    assert (seller.total_orders, seller.return_rate, seller.return_rate_all) == (3, 0.0, 0.25)
    pay = enrich.enrich_payments(payments(spark, [{"actual_payout": 50}, {"actual_payout": 80}, {}]))
    disputes = summaries.discrepancy_summary(pay).first()
    assert (disputes.disputed_payments, disputes.total_discrepancy_amt, disputes.avg_discrepancy_pct) == (2, money(70), 35.0)
