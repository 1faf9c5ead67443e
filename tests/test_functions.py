from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaarlens.functions import calendar, normal, numeric, ordered, quantiles
from helpers import plan_of


def test_normal_tail_matches_erfc(spark):
    xs = [i / 16 for i in range(0, 16 * 9)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.select("x", normal.upper_tail(F.col("x")).alias("t"), normal.cdf(-F.col("x")).alias("c")).collect():
        exact = 0.5 * math.erfc(row.x / math.sqrt(2))
        assert row.t == pytest.approx(exact, rel=1e-9, abs=1e-15)
        assert row.c == pytest.approx(exact, rel=1e-9, abs=1e-15)


def test_normal_far_tail_and_null(spark):
    row = spark.sql("SELECT 40D AS far, CAST(NULL AS DOUBLE) AS none").select(
        normal.upper_tail(F.col("far")).alias("far"), normal.two_sided_p(F.col("none")).alias("none")
    ).first()
    assert row.far == 0.0 and row.none is None


def test_rounding_is_half_up_on_the_decimal(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-0.125,), (0.004999999999,), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.rounded(F.col("x"), 2)).collect()] == [1.01, 2.68, -0.13, 0.0, None]


def test_ratio_of_zero_is_null(spark):
    assert spark.range(1).select(numeric.ratio(F.lit(1), F.lit(0))).first()[0] is None


def test_three_week_numberings(spark):
    days = ["2023-01-01", "2023-01-02", "2024-01-01", "2024-12-30", "2024-12-31"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", F.col("d").cast("timestamp").alias("t"))
    rows = df.select(
        "d",
        calendar.iso_week(F.col("t")).alias("iso"),
        calendar.iso_year(F.col("t")).alias("iso_year"),
        calendar.monday_week_number(F.col("t")).alias("w"),
        calendar.week_span_label(calendar.week_start(F.col("t"))).alias("span"),
    ).collect()
    assert [r.iso for r in rows] == [52, 1, 1, 1, 1]
    assert [r.iso_year for r in rows] == [2022, 2023, 2024, 2025, 2025]
    assert [r.w for r in rows] == [0, 1, 1, 53, 53]
    assert rows[0].span == "2022-12-26/2023-01-01"
    for row in rows:
        assert row.w == int(pd.Timestamp(row.d).strftime("%W"))


@pytest.mark.parametrize("size", [10, 1000, 500_000])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.8, 1.0])
def test_exact_quantile(spark, size, p):
    """Many ties, a long tail and negative values, by the same passes at every size."""
    rng = np.random.default_rng(7)
    values = np.round(np.where(rng.random(size) < 0.4, 0.0, rng.lognormal(3, 2, size) - 20), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": values})).withColumn("x", F.col("x").cast("decimal(18,2)"))
    got = quantiles.exact_quantile(df.repartition(4), "x", p).first()[0]
    assert got == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


@pytest.mark.parametrize("digits", [0, 2])
def test_exact_quantile_over_the_widest_range(spark, digits):
    """The whole numbers differ by more than 2^63."""
    top = 9 * 10**18 // 10**digits
    values = [-top, -3, 0, 1, 2, top // 2, top]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for p in (0.0, 0.3, 0.5, 0.9, 1.0):
        got = quantiles.exact_quantile(df, "x", p, digits=digits).first()[0]
        assert got == pytest.approx(float(np.quantile(np.array(values, float), p)), rel=1e-12)
    rows = quantiles.equal_width_histogram(df, "x", 2, digits).orderBy("bin").collect()
    assert [r.frequency for r in rows] == [2, 5]


@pytest.mark.parametrize("bits", [1, 3, 17])
def test_exact_quantile_whatever_the_buckets(spark, monkeypatch, bits):
    """Wide buckets with several values, and single values; also right at their bounds."""
    monkeypatch.setattr(quantiles, "LEADING_BITS", bits)
    values = [0] * 50 + list(range(-10, 30)) + [-(10**6), 10**6, 10**6 + 1, 10**6 + 1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for p in np.linspace(0, 1, 15):
        got = quantiles.exact_quantile(df, "x", float(p), digits=0).first()[0]
        assert got == pytest.approx(float(np.quantile(values, p)))


def test_buckets_ascend_with_the_values(spark):
    rng = random.Random(1)
    values = {0, 1, -1, 2**63 - 1, -(2**63 - 1)} | {s * (2**b + d) for s in (1, -1) for b in range(1, 62) for d in (-1, 0, 1)}
    values |= {rng.randrange(-(2**b), 2**b) for b in range(5, 63) for _ in range(20)}
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quantiles._bucket().alias("b"))
    buckets = [r.b for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets) and max(buckets) < 3_250_000


def test_exact_quantile_keeps_no_sketch(spark):
    plan = plan_of(quantiles.exact_quantile(spark.range(100), "id", 0.5))
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan


def test_exact_quantile_of_nothing_and_of_one(spark):
    assert quantiles.exact_quantile(spark.range(0), "id", 0.5).first()[0] is None
    assert quantiles.exact_quantile(spark.range(5, 6), "id", 0.5).first()[0] == 5.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-500, 500), min_size=1, max_size=40), st.sampled_from([0.25, 0.5, 0.8]))
def test_exact_quantile_any_small_list(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    assert quantiles.exact_quantile(df, "x", p).first()[0] == pytest.approx(float(np.quantile(values, p)))


def test_histogram_counts_everything(spark):
    values = [0.0, 0.0, 1.0, 5.0, 9.99, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = quantiles.equal_width_histogram(df, "x", 10, digits=2).orderBy("bin").collect()
    expected, edges = np.histogram(values, bins=10)
    assert [r.frequency for r in rows] == list(expected)
    assert [r.bin_start for r in rows] == pytest.approx(list(edges[:-1]))
    assert rows[-1].bin_end == pytest.approx(10.0)


def test_histogram_of_a_constant(spark):
    rows = quantiles.equal_width_histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 40, digits=2).collect()
    expected, edges = np.histogram([3.0] * 4, bins=40)
    assert [r.frequency for r in sorted(rows, key=lambda r: r.bin)] == list(expected)


def test_chunked_windows_match_plain_ones_on_a_hot_key(spark):
    """One key holds most rows; results equal a single ordered pass over each key."""
    rng = random.Random(3)
    rows = [
        ("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(30), rng.randrange(-5, 6), i)
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "k string, day int, v int, id int")
    keys, order = ["k"], [F.col("day"), F.col("id")]
    total = ordered.running_total(df, keys, ["day"], [F.col("day")], order, "v", "total")
    both = ordered.row_number(total, keys, ["day"], [F.col("day")], order, "n").toPandas()
    expected = pd.DataFrame(rows, columns=["k", "day", "v", "id"]).sort_values(["k", "day", "id"])
    expected["total"] = expected.groupby("k")["v"].cumsum()
    expected["n"] = expected.groupby("k").cumcount() + 1
    got = both.set_index("id").loc[expected["id"]]
    assert list(got["total"]) == list(expected["total"])
    assert list(got["n"]) == list(expected["n"])


def test_chunked_windows_treat_null_keys_and_values_like_plain_ones(spark):
    rows = [(None, 1, 10, 1), (None, 2, None, 2), (None, 2, 5, 3), ("a", 1, None, 4), ("a", 1, 7, 5), ("a", 3, None, 6), (None, 3, None, 7)]
    df = spark.createDataFrame(rows, "k string, day int, v int, id int")
    day, order = [F.col("day")], [F.col("day"), F.col("id")]
    got = ordered.running_total(df, ["k"], ["day"], day, order, "v", "total")
    got = ordered.row_number(got, ["k"], ["day"], day, order, "n").orderBy("id").collect()
    assert [r.total for r in got] == [10, 10, 15, None, 7, 7, 15]
    assert [r.n for r in got] == [1, 2, 3, 1, 2, 3, 4]
    assert got[0].asDict().keys() == {"k", "day", "v", "id", "total", "n"}


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 40)


def test_one_key_one_day_and_one_amount_are_cut_too(spark, monkeypatch):
    """200,000 rows that differ in their id alone."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 10_000)
    n = 200_000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.lit(1).alias("day"), F.lit(2).alias("v"), ((F.col("id") * 7919) % n).alias("id"))
    day, order = [F.col("day")], [F.col("day"), F.col("id")]
    cuts = ordered.cuts_of(df, ["k"], ["day"], order)
    sizes = ordered.cut(df, ["k"], ["day"], order, cuts).groupBy("day", "_part").count().toPandas()["count"]
    assert sizes.sum() == n and len(sizes) > 10 and sizes.max() < 10 * 10_000
    got = ordered.running_total(df, ["k"], ["day"], day, order, "v", "total")
    got = ordered.row_number(got, ["k"], ["day"], day, order, "n", base=df)
    assert got.where((F.col("n") != F.col("id") + 1) | (F.col("total") != 2 * F.col("n"))).isEmpty() and got.count() == n


def test_cut_chunks_match_plain_windows_with_nulls_and_ties(spark, small_chunks):
    rng = random.Random(4)
    rows = [
        (rng.choice(["hot", "hot", None, "k"]), rng.randrange(3), rng.choice([None, *range(-3, 4)]), rng.choice([None, 5, 6]), i)
        for i in range(2500)
    ]
    df = spark.createDataFrame(rows, "k string, day int, v int, w int, id int")
    order = [F.col("day"), F.col("w"), F.col("id")]
    got = ordered.running_total(df, ["k"], ["day"], [F.col("day")], order, "v", "total")
    got = ordered.row_number(got, ["k"], ["day"], [F.col("day")], order, "n", base=df)
    plain = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    expected = df.select("id", F.sum("v").over(plain).alias("total"), F.row_number().over(plain).alias("n"))
    assert sorted(map(tuple, got.select("id", "total", "n").collect())) == sorted(map(tuple, expected.collect()))


def test_keys_that_fit_a_task_cost_one_exchange_for_both_windows(spark):
    """As many chunks as rows, but small keys: no chunk totals, no offsets to join."""
    df = spark.range(2000).selectExpr("id % 50 k", "id % 40 day", "id v", "id")
    order = [F.col("day"), F.col("id")]
    got = ordered.running_total(df, ["k"], ["day"], [F.col("day")], order, "v", "total")
    got = ordered.row_number(got, ["k"], ["day"], [F.col("day")], order, "n", base=df)
    plan = plan_of(got)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert got.where("n = 1").count() == 50 and got.columns == ["k", "day", "v", "id", "total", "n"]


def test_large_and_small_keys_beside_each_other_match_plain_windows(spark, small_chunks):
    rng = random.Random(5)
    keys = ["hot"] * 500 + [None] * 300 + [f"k{i % 60}" for i in range(400)]
    rows = [(k, rng.choice([1, 2, 9]), rng.choice([None, 4, -2]), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, day int, v int, id int")
    large = ordered.large_keys(df, ["k"])
    assert sorted((r._key0, r._none0) for r in large.collect()) == [("0", True), ("hot", False)]
    up, down = [F.col("day"), F.col("id")], [F.desc("day"), F.col("id")]
    got = ordered.running_total(df, ["k"], ["day"], [F.col("day")], up, "v", "total", large=large)
    got = ordered.row_number(got, ["k"], ["day"], [F.desc("day")], [-F.col("day"), F.col("id")], "n", base=df, large=large)
    first = Window.partitionBy("k")
    total = F.sum("v").over(first.orderBy(*up).rowsBetween(Window.unboundedPreceding, 0))
    expected = df.select("id", total.alias("total"), F.row_number().over(first.orderBy(*down)).alias("n"))
    assert sorted(map(tuple, got.select("id", "total", "n").collect())) == sorted(map(tuple, expected.collect()))
