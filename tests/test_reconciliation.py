from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import enrich, payout_risk, reconciliation
from helpers import by, money, orders, payments, plan_of, sellers


def settled(spark, rows):
    """Orders and payments with matching ids; each row is (seller, day, expected, actual)."""
    made = [
        {"seller_id": s, "settlement_date": f"2024-{d} 00:00:00" if isinstance(d, str) else d, "expected_payout": e, "actual_payout": a}
        for s, d, e, a in rows
    ]
    paid = enrich.enrich_payments(payments(spark, made))
    clean = enrich.enrich_orders(orders(spark, [{"seller_id": r["seller_id"], "order_date": "2024-01-01 12:00:00"} for r in made]))
    return clean, paid, sellers(spark, sorted({r["seller_id"] for r in made}))


@pytest.fixture(scope="module")
def case(spark):
    rows = [("A", "01-10", 100, 100), ("A", "01-20", 100, 60), ("A", "09-20", 100, 50), ("B", "02-01", 100, 90)]
    rows += [("B", "04-15", 100, 95), ("C", "03-01", 100, 99), ("D", "03-01", 100, 100), ("E", "05-01", 100, 80), ("E", "05-20", 100, 99)]
    return settled(spark, rows)


def test_report_patterns_and_score(case):
    rows = by(reconciliation.reconciliation_report(*case), "seller_id")
    assert set(rows) == {"A", "B", "C", "E"}
    assert rows["A"].dispute_pattern == "Chronic (>6 months)"
    assert rows["B"].dispute_pattern == "Recurring (2-6 months)"
    assert rows["E"].dispute_pattern == "Isolated (<2 months)"
    assert rows["C"].dispute_pattern == "Single Event" and rows["C"].dispute_span_days == 0
    a = rows["A"]
    assert (a.total_payments, a.disputed_count, a.dispute_rate_pct, a.total_discrepancy_amt) == (3, 2, 66.67, money(90))
    assert a.months_with_disputes == 2 and a.avg_discrepancy_pct == 45.0
    assert a.triage_priority_score == pytest.approx(90 / 10000 * 0.5 + 66.67 * 0.3 + 244 / 365 * 20, abs=0.06)


def test_audit_status(case):
    rows = by(reconciliation.seller_discrepancy_summary(*case), "seller_id")
    # Totals 90, 15, 1, 0, 21: the 0.75 quantile is 21 and must be exceeded.
    assert rows["A"].audit_status == "MANDATORY_AUDIT"
    assert rows["E"].audit_status == "REVIEW_REQUIRED"
    assert rows["D"].audit_status == "CLEAN"
    assert str(rows["A"].first_dispute_date) == "2024-01-10 00:00:00"


def test_timeline_and_top(case):
    rows = by(reconciliation.dispute_timeline(*case), "seller_id")
    assert rows["A"].dispute_events == 2 and str(rows["A"].first_dispute) == "2024-01-20 00:00:00"
    top = reconciliation.top_discrepancies_per_seller(*case, n=1).collect()
    assert {r.seller_id: float(r.discrepancy_amt) for r in top} == {"A": 50, "B": 10, "C": 1, "D": 0, "E": 20}


def test_cycles_sort_as_text_and_in_time(spark):
    data = settled(spark, [("A", "01-10", 100, 100), ("A", "02-28", 100, 90), ("A", "03-05", 100, 100), ("A", "03-06", 100, 90)])
    paid = enrich.enrich_payments(enrich.derive_discrepancy(data[1]))
    text = by(reconciliation.settlement_cycle_anomalies(data[0], paid, data[2]), "settlement_cycle")
    assert set(text) == {"W2", "W9", "W10"}
    assert text["W10"].dispute_rate_wow_change is None and text["W2"].dispute_rate_wow_change == -50
    chrono = by(reconciliation.settlement_cycle_anomalies_chrono(data[0], paid, data[2]), "settlement_week")
    assert (chrono[2].dispute_rate_wow_change, chrono[9].dispute_rate_wow_change, chrono[10].dispute_rate_wow_change) == (None, 100, -50)


def test_audit_trail_of_a_dominant_seller_matches_one_ordered_pass(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(600):
        short = rng.choice([0, 0, 0, 0.01, 0.07, -0.03, 5, 5, 40, 900.5])
        rows.append(("HOT" if rng.random() < 0.6 else f"S{rng.randrange(4)}", f"{rng.randrange(1, 7):02d}-{rng.randrange(1, 28):02d}", 1000, 1000 - short))
    data = settled(spark, rows)
    got = reconciliation.payment_audit_trail(*data).toPandas()
    assert len(got) == 600 and len(got.columns) == 24
    got = got.sort_values(["seller_id", "settlement_date", "payment_id"])
    assert list(got["cumulative_discrepancy_by_seller"]) == list(got.groupby("seller_id")["discrepancy_amt"].transform(lambda s: s.cumsum()))
    got["neg"] = -got["discrepancy_amt"].astype(float)
    got = got.sort_values(["seller_id", "neg", "settlement_date", "payment_id"])
    assert list(got["rank_within_seller"]) == list(got.groupby("seller_id").cumcount() + 1)
    first = got.iloc[0]
    assert first["settlement_delay_days"] == (first["settlement_date"] - first["order_date"]).total_seconds() / 86400


def test_audit_trail_joins_orders_and_payments_once(spark):
    """The written payouts carry the whole row, so the windows' plan holds no second join of the inputs."""
    data = settled(spark, [("A", "01-10", 100, 100), ("A", "02-28", 100, 90), ("B", "03-05", 100, 95)])
    plan = plan_of(reconciliation.payment_audit_trail(*data))
    assert plan.count("Window [") == 2 and plan.count("Join") == 1


def test_audit_trail_is_the_same_with_and_without_chunks(spark, monkeypatch):
    rng = random.Random(12)
    rows = [("HOT" if rng.random() < 0.6 else f"S{rng.randrange(9)}", f"0{rng.randrange(1, 4)}-1{rng.randrange(4)}", 1000, 1000 - rng.choice([0, 0, 3, 40])) for _ in range(400)]
    data = settled(spark, rows)
    plain = reconciliation.payment_audit_trail(*data).collect()
    monkeypatch.setattr(reconciliation.ordered, "CHUNK_ROWS", 30)
    chunked = reconciliation.payment_audit_trail(*data)
    assert "_chunk_total" in plan_of(chunked)
    assert sorted(plain) == sorted(chunked.collect()) and len(plain) == 400


def test_risk_scores_and_tiers(spark):
    paid = enrich.enrich_payments(payments(spark, [{"actual_payout": a} for a in (100, 95, 85, 70, 50)]))
    rows = by(payout_risk.disputed_payments(paid), "payment_id")
    assert [rows[f"P0000{i}"].severity_tier for i in range(1, 5)] == ["Minor (<5%)", "Moderate (5-15%)", "High (15-30%)", "Critical (>30%)"]
    assert rows["P00004"].risk_score == 1.0 and rows["P00001"].risk_score == 0.1
    tiers = payout_risk.severity_breakdown(paid).collect()
    assert [(r.severity_tier, r.cases) for r in tiers][0] == ("Minor (<5%)", 1) and len(tiers) == 4


def test_audit_threshold_is_inclusive(spark):
    made = [{"seller_id": f"S{i}", "actual_payout": 100 - i} for i in range(1, 7)]
    paid = enrich.enrich_payments(payments(spark, made))
    known = sellers(spark, ["S1", "S6"])
    rows = payout_risk.seller_audit_list(paid, known).collect()
    assert [r.seller_id for r in rows] == ["S6", "S5", "S4", "S3", "S2", "S1"]
    # Totals 1..6: the 0.8 quantile is exactly 5.
    assert [r.audit_required for r in rows] == [True, True, False, False, False, False]
    assert rows[0].seller_name == "Seller S6" and rows[1].seller_name is None
    total = payout_risk.reconciliation_totals(paid).first()
    assert (total.total_payments, total.total_discrepancy, total.discrepancy_rate_pct, total.sellers_flagged) == (6, money(21), 100.0, 2)
    top = payout_risk.top_risk_sellers(paid, known, 2).collect()
    assert [r.risk_flag for r in top] == ["🔴", "🔴"]


def test_no_disputes_at_all(spark):
    paid = enrich.enrich_payments(payments(spark, [{}, {}]))
    total = payout_risk.reconciliation_totals(paid).first()
    assert (total.total_discrepancy, total.sellers_flagged) == (money(0), 0)
    assert payout_risk.disputed_payments(paid).count() == 0
    assert payout_risk.discrepancy_pct_histogram(paid).count() == 0


def test_pct_histogram_and_trend(spark):
    paid = enrich.enrich_payments(payments(spark, [{"actual_payout": 100 - p, "settlement_date": f"2024-0{1 + p % 3}-02 00:00:00"} for p in (10, 20, 30, 40)]))
    rows = payout_risk.discrepancy_pct_histogram(paid).orderBy("bin").collect()
    assert len(rows) == 40 and sum(r.frequency for r in rows) == 4 and rows[0].median_pct == 25.0
    months = payout_risk.monthly_discrepancy_trend(paid).collect()
    assert [(str(r.month), float(r.discrepancy_amt)) for r in months] == [("2024-01-01", 30), ("2024-02-01", 50), ("2024-03-01", 20)]
