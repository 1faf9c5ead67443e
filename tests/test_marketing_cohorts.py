from __future__ import annotations

import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazaarlens import schemas
from bazaarlens.operators import attribution, channel_roi, cohorts, enrich
from helpers import by, money, orders, when

# A published channel report (orders, gmv, net revenue, spend, impressions,
# clicks) and the ratios that must come out of it (roi, cpa, ctr, revenue share, spend
# share, efficiency).
PUBLISHED = {
    "social_organic": ((11704, "43741059.88", "37030858.78", "11415736.45", 1443302065, 57395735), (3.24, 975.37, 3.977, 10.05, 2.91, 3.45)),
    "email": ((17493, "65926545.08", "55627004.92", "46493329.94", 5730142117, 233689116), (1.2, 2657.82, 4.078, 15.09, 11.84, 1.27)),
}
TOTAL_NET, TOTAL_SPEND = Decimal("368591272.96"), Decimal("392817052.38")


def spend(spark, rows):
    return spark.createDataFrame([(when("2024-01-01").date(), c, money(s), i, k) for c, s, i, k in rows], schemas.MARKETING_SPEND)


def test_roi_reproduces_published_ratios(spark):
    """One order per channel carries the money; further orders of value zero bring the count."""
    rest_net = TOTAL_NET - sum(Decimal(v[0][2]) for v in PUBLISHED.values())
    rest_spend = TOTAL_SPEND - sum(Decimal(v[0][3]) for v in PUBLISHED.values())
    inputs = {k: v[0] for k, v in PUBLISHED.items()} | {"rest": (1, str(rest_net), str(rest_net), str(rest_spend), 1, 0)}
    first = spark.createDataFrame(
        [(c, n, money(g), money(r)) for c, (n, g, r, *_ ) in inputs.items()], "channel string, n int, gmv decimal(18,2), net_revenue decimal(18,2)"
    )
    many = first.select("channel", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("i", "x"), "gmv", "net_revenue").select(
        "channel", F.lit(1).alias("is_delivered"), F.col("i").alias("order_id"),
        *[F.when(F.col("i") == 0, F.col(m)).otherwise(0).cast("decimal(18,2)").alias(m) for m in ("gmv", "net_revenue")],
    )
    rows = by(channel_roi.channel_roi(many, spend(spark, [(c, v[3], v[4], v[5]) for c, v in inputs.items()])), "channel")
    for channel, (_, ratios) in PUBLISHED.items():
        r = rows[channel]
        assert (r.roi, r.cpa, r.ctr, r.revenue_share, r.spend_share, r.efficiency_score) == ratios


@pytest.fixture(scope="module")
def roi_case(spark):
    clean = enrich.enrich_orders(orders(spark, [{"channel": c, "gmv": 300} for c in ("free", "good", "poor", "unknown")] + [{"channel": "good", "status": "returned"}]))
    cost = spend(spark, [("free", 0, 100, 5), ("good", 100, 1000, 10), ("poor", 300, 0, 0)])
    return clean, cost


def test_channels_without_spend(roi_case):
    rows = by(channel_roi.channel_roi(*roi_case), "channel")
    assert (rows["free"].roi, rows["free"].cpa, rows["free"].ctr, rows["free"].efficiency_score) == (None, 0, 5.0, None)
    assert (rows["unknown"].roi, rows["unknown"].total_spend, rows["unknown"].ctr) == (None, 0, 0)
    assert (rows["good"].roi, rows["good"].cpa, rows["good"].spend_share, rows["good"].efficiency_score) == (3.0, 100.0, 25.0, 1.0)
    assert sum(r.revenue_share for r in rows.values()) == pytest.approx(100)
    assert [r.channel for r in channel_roi.channel_roi(*roi_case).collect()] == ["good", "poor", "free", "unknown"]


def test_recommendation_and_text(roi_case):
    rows = by(channel_roi.roi_recommendation(*roi_case), "channel")
    assert rows["good"].flag == "⭐" and rows["good"].is_best and not rows["good"].is_worst
    assert rows["poor"].flag == "⚠️" and rows["poor"].is_worst
    assert rows["free"].flag == "" and not rows["free"].has_roi and not rows["free"].has_spend
    text = by(channel_roi.channel_scorecard_text(*roi_case), "channel")
    assert (text["good"].roi_text, text["good"].cpa_text, text["good"].revenue_share_text) == ("3.0x", "₹100", "25.0%")
    assert (text["free"].roi_text, text["free"].cpa_text) == ("organic", "—")


def test_weekly_trend_of_top_channels(roi_case):
    rows = channel_roi.top_channel_weekly_trend(*roi_case, n=2).collect()
    assert {r.channel for r in rows} == {"good", "poor"} and {str(r.week) for r in rows} == {"2024-01-15 00:00:00"}


def customers(spark, pairs):
    return spark.createDataFrame(pairs, "customer_id string, acquisition_channel string")


def test_acquisition_ltv_counts_customers_without_orders(spark):
    clean = enrich.enrich_orders(orders(spark, [{"customer_id": "C1", "gmv": 100}, {"customer_id": "C1", "gmv": 50}, {"customer_id": "C2", "gmv": 900, "status": "returned"}, {"customer_id": "C9", "gmv": 5}]))
    rows = by(attribution.acquisition_ltv(customers(spark, [("C1", "email"), ("C2", "email"), ("C3", "ads"), ("C9", "ref")]), clean), "acquisition_channel")
    email = rows["email"]
    assert (email.acquired_customers, email.lifetime_orders, email.lifetime_revenue, email.ltv_per_customer, email.avg_revenue_per_order) == (2, 2, 150, 75.0, 75.0)
    assert (rows["ads"].acquired_customers, rows["ads"].lifetime_orders, rows["ads"].ltv_per_customer) == (1, 0, None)
    assert (email.ltv_rank, rows["ref"].ltv_rank, rows["ads"].ltv_rank) == (1, 2, 3)


def test_new_and_returning_match_brute_force(spark):
    rng = random.Random(5)
    made = [{"customer_id": f"C{rng.randrange(12)}", "channel": rng.choice("abc"), "order_date": f"2024-01-{rng.randrange(1, 9):02d} 00:00:00"} for _ in range(120)]
    clean = enrich.enrich_orders(orders(spark, made))
    seq = attribution.order_sequence(clean).toPandas()
    expected = seq.sort_values(["customer_id", "order_date", "order_id"])
    assert list(expected["order_seq"]) == list(expected.groupby("customer_id").cumcount() + 1)
    rows = by(attribution.new_vs_returning(clean), "channel")
    for channel, group in seq.groupby("channel"):
        assert rows[channel].new_customers == group.loc[group.order_seq == 1, "customer_id"].nunique()
        assert rows[channel].returning_customers == group.loc[group.order_seq > 1, "customer_id"].nunique()
        assert rows[channel].total_unique_customers == group["customer_id"].nunique()


def test_channel_trend_uses_rows_not_calendar_months(spark):
    made = [{"order_date": f"2024-{m}-03 00:00:00", "gmv": g} for m, g in (("01", 100), ("02", 150), ("05", 300), ("06", 0))]
    rows = attribution.monthly_channel_trend(enrich.enrich_orders(orders(spark, made))).orderBy("order_month").collect()
    assert [r.mom_revenue_growth_pct for r in rows] == [None, 50.0, 100.0, -100.0]
    assert [r.rolling_3m_avg_revenue for r in rows] == [100.0, 125.0, 183.33, 150.0]


def test_scorecard_signals(spark):
    made = [{"customer_id": f"N{i}", "channel": "grow", "gmv": 100} for i in range(5)]
    made += [{"customer_id": "R", "channel": "start", "order_date": "2023-01-01 00:00:00", "gmv": 10}]
    made += [{"customer_id": "R", "channel": "keep", "gmv": 50, "discount_amount": 20}] * 2
    clean = enrich.enrich_orders(orders(spark, made))
    people = customers(spark, [(f"N{i}", "grow") for i in range(5)] + [("R", "keep")])
    rows = by(attribution.channel_scorecard(clean, people), "channel")
    assert rows["grow"].strategic_signal.startswith("SCALE UP")
    assert rows["keep"].strategic_signal.startswith("RETENTION CHANNEL")
    assert rows["start"].strategic_signal == "MONITOR" and rows["start"].ltv_rank is None
    assert attribution.channel_scorecard(clean, people).collect()[-1].channel == "start"
    assert sum(r.revenue_share_pct for r in attribution.channel_revenue(clean).collect()) == pytest.approx(100, abs=0.05)


def cohort_orders(spark):
    made = []
    for customer, months in {"A": ["2023-01", "2023-02", "2024-01"], "B": ["2023-01", "2023-03"], "C": ["2023-03", "2023-03"], "D": ["2022-12"]}.items():
        made += [{"customer_id": customer, "order_date": f"{m}-05 00:00:00", "gmv": 100} for m in months]
    made += [{"customer_id": "C", "order_date": "2022-01-01 00:00:00", "status": "cancelled"}]
    return enrich.enrich_orders(orders(spark, made))


def test_cohort_activity_and_retention(spark):
    clean = cohort_orders(spark)
    activity = cohorts.cohort_activity(clean).toPandas()
    assert len(activity) == 7  # the order twelve months later is outside
    assert set(activity.loc[activity.customer_id == "C", "cohort_month"]) == {"2023-03"}
    rows = by(cohorts.cohort_retention_matrix(clean), "cohort_month")
    january = rows["2023-01"]
    assert (january.m0, january.m1, january.m2, january.m3) == (1.0, 0.5, 0.5, None)
    assert all(r.m0 == 1.0 for r in rows.values())
    users = cohorts.cohort_active_users(clean).where("cohort_month = '2023-01' AND period_number = 1").first()
    assert (users.active_users, users.cohort_size) == (1, 2)


def test_ltv_carries_forward_and_observed_does_not(spark):
    clean = cohort_orders(spark)
    ltv = by(cohorts.cohort_ltv_matrix(clean), "cohort_month")
    assert (ltv["2023-01"].m0, ltv["2023-01"].m1, ltv["2023-01"].m2) == (100.0, 150.0, 200.0)
    assert ltv["2023-03"].m2 == 200.0
    # No cohort has activity in period 3 or later.
    assert ltv["2023-01"].m3 is None
    for row in ltv.values():
        cells = [row[f"m{k}"] for k in range(3)]
        assert cells == sorted(cells)
    observed = by(cohorts.cohort_ltv_observed(clean), "cohort_month")
    assert observed["2023-03"].observed_months == 11 and observed["2022-12"].observed_months == 12


def test_cohort_report(spark):
    made = [{"customer_id": c, "order_date": f"2023-{m}-01 00:00:00", "gmv": 100} for c, ms in {"A": ("01", "02"), "B": ("01",), "C": ("02", "03", "08")}.items() for m in ms]
    row = cohorts.cohort_report(enrich.enrich_orders(orders(spark, made))).first()
    assert (row.avg_m1_retention_pct, row.best_m1_cohort, row.worst_m1_cohort) == (75.0, "2023-02", "2023-01")
    assert row.avg_m3_retention_pct is None and row.avg_m6_retention_pct == 100.0
    assert row.avg_6m_ltv == 225.0


@pytest.fixture(scope="module")
def unknown_customers(spark):
    rows = [
        {"order_id": "O1", "customer_id": "C1", "order_date": "2024-01-05 10:00:00", "gmv": 100},
        {"order_id": "O2", "customer_id": None, "order_date": "2024-01-06 10:00:00", "gmv": 1200},
        {"order_id": "O3", "customer_id": None, "order_date": "2024-02-06 10:00:00", "gmv": 500},
        {"order_id": "O4", "customer_id": "C1", "order_date": "2024-02-07 10:00:00", "gmv": 40},
    ]
    named = orders(spark, [{**r, "customer_id": r["customer_id"] or "nobody"} for r in rows])
    return enrich.enrich_orders(named.withColumn("customer_id", F.expr("nullif(customer_id, 'nobody')")))


def test_order_sequence_numbers_orders_without_a_customer(unknown_customers):
    rows = by(attribution.order_sequence(unknown_customers), "order_id")
    assert {k: r.order_seq for k, r in rows.items()} == {"O1": 1, "O2": 1, "O3": 2, "O4": 2}


def test_unknown_customers_count_for_no_customer_figure(unknown_customers):
    (mix,) = attribution.new_vs_returning(unknown_customers).collect()
    assert (mix.new_customers, mix.returning_customers, mix.total_unique_customers, mix.new_customer_pct) == (1, 1, 1, 100.0)
    (value,) = cohorts.cohort_ltv_matrix(unknown_customers).collect()
    known = unknown_customers.where("customer_id IS NOT NULL")
    assert value == cohorts.cohort_ltv_matrix(known).first()
    for report in (cohorts.cohort_active_users, cohorts.cohort_retention_matrix, cohorts.cohort_ltv_observed, cohorts.cohort_report, cohorts.cohort_activity):
        assert report(unknown_customers).collect() == report(known).collect()
