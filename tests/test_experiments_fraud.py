from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import anomalies, enrich, experiments, fraud_signals
from helpers import by, money, orders, payments, plan_of

# Published tests (control n, conversions, variant n, conversions, z, p).
PUBLISHED = [
    ("all", 150391, 4712, 149609, 4959, 2.8137, 0.004897),
    ("mobile", 96151, 2990, 95576, 3159, 2.4296, 0.015114),
    ("desktop", 45101, 1419, 45076, 1503, 1.5950, 0.110713),
    ("tablet", 9139, 303, 8957, 297, 0.0014, 0.998858),
]


def counts(spark, rows):
    return spark.createDataFrame(rows, "name string, control_n long, control_conv long, variant_n long, variant_conv long")


def test_published_statistics(spark):
    rows = by(experiments.two_proportion_z_test(counts(spark, [r[:5] for r in PUBLISHED])), "name")
    for name, *_, z, p in PUBLISHED:
        assert rows[name].z_statistic == z and rows[name].p_value == p
    everyone = rows["all"]
    assert (everyone.control_conv_rate, everyone.variant_conv_rate, everyone.absolute_lift_pp, everyone.relative_lift_pct) == (3.1332, 3.3146, 0.1815, 5.79)
    assert (everyone.ci_95_lower_pp, everyone.ci_95_upper_pp, everyone.is_significant) == (0.0551, 0.3079, True)
    assert rows["desktop"].is_significant is False


def test_small_and_degenerate_arms(spark):
    data = [("big", 50000, 1500, 50000, 1800), ("none", 500, 15, 500, 16), ("up", 10000, 300, 10000, 380), ("span", 200, 10, 200, 11), ("rate", 1000, 30, 1000, 35), ("zero", 100, 0, 100, 0), ("empty", 0, 0, 10, 1)]
    rows = by(experiments.two_proportion_z_test(counts(spark, data)), "name")
    assert rows["big"].is_significant and rows["big"].p_value < 0.05 and not rows["none"].is_significant
    assert rows["up"].absolute_lift_pp > 0 and rows["up"].relative_lift_pct > 0
    assert rows["span"].ci_95_lower_pp < 0 < rows["span"].ci_95_upper_pp
    assert (rows["rate"].control_conv_rate, rows["rate"].variant_conv_rate) == (3.0, 3.5)
    assert rows["zero"].z_statistic is None and rows["zero"].is_significant is False
    assert rows["empty"].p_value is None and rows["empty"].is_significant is False


def test_sample_size_and_power(spark):
    df = spark.createDataFrame([(0.03, 0.01), (0.03, 0.002), (0.031332, 0.002)], "b double, e double")
    assert [r[0] for r in df.select(experiments.sample_size(F.col("b"), F.col("e"))).collect()] == [5301, 117886, 122782]
    df = spark.createDataFrame([(1000, 0.005), (20000, 0.005), (5000, 0.003)], "n long, e double")
    low, high, middle = [r[0] for r in df.select(experiments.power_at(F.col("n"), F.lit(0.03), F.col("e"))).collect()]
    assert high > low and 0 <= middle <= 1


def sessions(spark, rows):
    return spark.createDataFrame(rows, "ab_variant string, device string, session_date timestamp, converted int")


def test_segments_need_a_hundred_sessions_per_arm(spark):
    day = datetime(2024, 1, 1)
    made = [(arm, "mobile", day, int(i < 10)) for arm in ("control", "variant_b") for i in range(100)]
    made += [("control", "tablet", day, 0)] * 99 + [("variant_b", "tablet", day, 1)] * 200
    df = sessions(spark, made)
    assert [r.segment for r in experiments.ab_segment_results(df).collect()] == ["mobile"]
    whole = experiments.ab_test_result(df).first()
    assert (whole.control_n, whole.variant_n, whole.decision) == (199, 300, "✅ SHIP IT")
    curve = experiments.ab_power_curve(df).where("segment = 'mobile'").orderBy("n").collect()
    assert len(curve) == 40 and [r.power for r in curve] == sorted(r.power for r in curve) and curve[-1].n == 196000
    assert experiments.ab_required_sample(df).count() == 2 and experiments.ab_observed_power(df).count() == 2
    for report in (experiments.ab_required_sample, experiments.ab_observed_power):
        (row,) = report(df, segment=None).collect()
        arms = experiments.ab_arm_counts(df).first()
        assert row.segment == "all" and row.baseline_rate == pytest.approx(arms.control_conv / arms.control_n, abs=1e-6)


def test_rolling_conversion_needs_seven_days(spark):
    start = datetime(2024, 1, 1, 9)
    made = [("control", "mobile", start + timedelta(days=d), int(d % 2 == 0)) for d in range(8)]
    rows = experiments.ab_daily_rolling_conversion(sessions(spark, made)).orderBy("date").collect()
    assert [r.rolling_rate for r in rows] == [None] * 6 + [pytest.approx(57.1429), pytest.approx(42.8571)]


def test_weekly_orders_split_at_new_year(spark):
    made = [{"order_date": f"{d} 10:00:00", "status": s} for d, s in (("2023-12-31", "returned"), ("2024-01-01", "delivered"), ("2023-01-01", "delivered"))]
    rows = by(fraud_signals.weekly_seller_orders(enrich.enrich_orders(orders(spark, made))), "week")
    assert set(rows) == {"2023-W52", "2024-W01", "2023-W00"} and rows["2023-W52"].weekly_return_rate == 100.0


def busy_weeks(spark):
    """Forty ordinary seller weeks and one very busy one."""
    made = [{"seller_id": f"S{i}", "order_date": "2024-01-03 00:00:00", "gmv": 10} for i in range(40)]
    made += [{"seller_id": "BUSY", "order_date": f"2024-01-{d:02d} 00:00:00", "gmv": 10} for d in (1, 2, 3, 4, 5, 6, 7) for _ in range(4)]
    return enrich.enrich_orders(orders(spark, made))


def test_both_velocity_definitions(spark):
    clean = busy_weeks(spark)
    assert [r.seller_id for r in fraud_signals.high_velocity(clean).collect()] == ["BUSY"]
    row = anomalies.high_velocity_sellers(clean).first()
    n = pd.Series([1] * 40 + [28])
    z = ((n - n.mean()) / n.std()).iloc[-1]
    assert row.week == "2024-01-01/2024-01-07" and row.order_z == pytest.approx(z) and row.combined_z == pytest.approx(z)
    assert anomalies.top_velocity_sellers(clean).first().severity == "red"


def test_constant_and_single_series_are_not_anomalous(spark):
    one = enrich.enrich_orders(orders(spark, [{}]))
    assert anomalies.high_velocity_sellers(one).count() == 0
    assert anomalies.refund_anomalies(one).count() == 0
    assert anomalies.fraud_score_histogram(one).count() == 0
    assert fraud_signals.high_velocity(one).count() == 0


def returning(spark):
    """Twelve sellers with 20 orders; W and X return much, X sells much."""
    made = []
    for i in range(12):
        name = {0: "X", 1: "W"}.get(i, f"S{i:02d}")
        returns = {0: 16, 1: 6}.get(i, 2)
        made += [{"seller_id": name, "status": "returned" if k < returns else "delivered", "gmv": 5000 if i == 0 else 100, "order_date": "2024-06-01 00:00:00"} for k in range(20)]
    made += [{"seller_id": "SMALL", "status": "returned", "order_date": "2024-06-01 00:00:00"}] * 19
    made += [{"seller_id": "OLD", "status": "returned", "order_date": "2023-01-01 00:00:00"}] * 30
    return enrich.enrich_orders(orders(spark, made))


def escalating(spark):
    made = [{"seller_id": s, "settlement_date": f"2024-0{m}-05 00:00:00", "actual_payout": 100 - a} for s, steps in {"X": (1, 2, 3), "W": (3, 2, 3), "Y": (1, 2)}.items() for m, a in enumerate(steps, 1)]
    return enrich.enrich_payments(payments(spark, made))


def test_return_signals(spark):
    rows = by(fraud_signals.return_anomaly(returning(spark), "2024-06-30"), "seller_id")
    assert {k: r.return_signal for k, r in rows.items()} == {"X": "RETURN_ABUSE_HIGH_RISK", "W": "RETURN_RATE_ELEVATED"}


def test_escalation(spark):
    rows = by(fraud_signals.escalating_sellers(escalating(spark)), "seller_id")
    assert {k: r.escalation_status for k, r in rows.items()} == {"X": "ESCALATING — INVESTIGATE", "W": "STABLE"}
    assert rows["X"].months_with_increase == 2 and rows["X"].total_disc_amt == money(6)


def test_risk_register_tiers(spark):
    base = datetime(2024, 6, 1)
    quick = orders(spark, [{"seller_id": "X", "gmv": 6000, "order_date": base + timedelta(hours=h)} for h in (0, 5, 40)])
    rows = fraud_signals.fraud_risk_register(returning(spark), escalating(spark), quick, "2024-06-30").collect()
    assert [(r.seller_id, r.risk_tier, r.rapid_repeat_order_events) for r in rows] == [
        ("X", "🔴 CRITICAL — SUSPEND ACCOUNT", 1),
        ("W", "🟡 HIGH — MANUAL REVIEW", 0),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_rapid_repeats_match_all_pairs(spark, seed):
    """Two customers only, so that one pair of keys holds most orders; times sit on slot edges too."""
    rng = random.Random(seed)
    base = datetime(2024, 3, 1)
    made = []
    for _ in range(150):
        offset = timedelta(hours=12 * rng.randrange(20)) if rng.random() < 0.3 else timedelta(seconds=rng.randrange(20 * 43200))
        made.append({"customer_id": "HOT" if rng.random() < 0.8 else "C2", "order_date": base + offset, "gmv": rng.choice([100, 5000, 5000.01, 9000])})
    df = orders(spark, made)
    local = df.toPandas()
    expected = {
        (a.order_id, b.order_id)
        for a in local.itertuples()
        for b in local.itertuples()
        if a.customer_id == b.customer_id and a.gmv > 5000 and timedelta(0) < b.order_date - a.order_date < timedelta(hours=12)
    }
    pairs = fraud_signals.rapid_repeat_orders(df).collect()
    assert len(pairs) == len(expected) and {(r.first_order_id, r.repeat_order_id) for r in pairs} == expected
    assert fraud_signals.rapid_repeat_counts(df).first().rapid_repeat_order_events == len({a for a, _ in expected})


def test_repeats_of_one_hour_are_formed_in_many_tasks(spark, monkeypatch):
    """600 orders of one customer at one seller in one hour, in blocks of about 20."""
    monkeypatch.setattr(fraud_signals, "REPEAT_BLOCK", 20)
    base, rng = datetime(2024, 3, 1), random.Random(5)
    made = [{"order_date": base + timedelta(seconds=rng.randrange(3600)), "gmv": 9000 if i % 10 == 0 else 10} for i in range(600)]
    df = orders(spark, made + [{"customer_id": "C2", "gmv": 9000}, {"customer_id": "C2", "order_date": "2024-01-15 11:00:00"}])
    local = df.toPandas()
    expected = {
        (a.order_id, b.order_id)
        for a in local[local.gmv > 5000].itertuples()
        for b in local.itertuples()
        if a.customer_id == b.customer_id and timedelta(0) < b.order_date - a.order_date < timedelta(hours=12)
    }
    pairs = fraud_signals.rapid_repeat_orders(df)
    found = pairs.collect()
    assert len(found) == len(expected) and {(r.first_order_id, r.repeat_order_id) for r in found} == expected
    assert "_block" in plan_of(pairs).split("SortMergeJoin [seller_id")[1].split("]")[0]


def test_refund_anomaly_scores(spark):
    clean = returning(spark)
    row = anomalies.refund_anomalies(clean).where("seller_id = 'X'").first()
    assert row is None or row.return_rate_z > 2.5
    made = [{"seller_id": f"S{i:02d}", "status": "returned" if k < (15 if i == 0 else 1) else "delivered"} for i in range(12) for k in range(20)]
    row = anomalies.refund_anomalies(enrich.enrich_orders(orders(spark, made))).first()
    rates = pd.Series([0.75] + [0.05] * 11)
    z = ((rates - rates.mean()) / rates.std()).iloc[0]
    assert row.seller_id == "S00" and row.return_rate_z == pytest.approx(z) and row.fraud_score == pytest.approx(0.7 * z, abs=1e-4)


def test_gmv_spikes_against_pandas(spark):
    start = datetime(2024, 1, 1)
    values = [100, 102, 98, 101, 99, 100, 103, 97, 100, 101, 99, 100, 102, 5000, 100, 100]
    clean = enrich.enrich_orders(orders(spark, [{"order_date": start + timedelta(days=i), "gmv": v} for i, v in enumerate(values)]))
    rows = anomalies.gmv_spikes(clean).collect()
    series = pd.Series(values, dtype=float)
    mean, std = series.rolling(14, min_periods=7).mean(), series.rolling(14, min_periods=7).std()
    for i, row in enumerate(rows):
        if i < 6:
            assert row.rolling_mean is None and row.is_spike is False
        else:
            assert row.rolling_mean == pytest.approx(mean[i]) and row.z_score == pytest.approx((series[i] - mean[i]) / std[i])
    assert [i for i, r in enumerate(rows) if r.is_spike] == [13]
    flat = enrich.enrich_orders(orders(spark, [{"order_date": start + timedelta(days=i)} for i in range(8)]))
    assert all(r.z_score is None and not r.is_spike for r in anomalies.gmv_spikes(flat).collect())
    assert anomalies.anomaly_summary(clean).first().spike_days == 1
