"""Two-arm experiments: conversion by arm, z-test, segments, sample size and power.

All figures are column expressions over one row per segment, whatever the number of
sessions behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import normal
from bazaarlens.functions.numeric import ratio, rounded

# Arms, defaults and texts.
CONTROL, VARIANT = "control", "variant_b"
ALPHA, POWER, EFFECT = 0.05, 0.80, 0.002
MIN_ARM = 100
ROLLING_ROWS = 7
CURVE_START, CURVE_STOP, CURVE_STEP = 1000, 200_000, 5000
ALL_SESSIONS = "all"
SHIP, CONTINUE = "✅ SHIP IT", "⏳ CONTINUE"


def ab_arm_counts(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sessions and conversions per arm, as one row per ``by`` group."""
    measures = []
    for prefix, arm in (("control", CONTROL), ("variant", VARIANT)):
        inside = F.col("ab_variant") == arm
        measures.append(F.count_if(inside).alias(f"{prefix}_n"))
        converted = F.sum(F.when(inside, F.col("converted")))
        measures.append(F.coalesce(converted, F.lit(0)).cast("bigint").alias(f"{prefix}_conv"))
    return sessions.groupBy(*by).agg(*measures)


def _rate(prefix: str) -> Column:
    return ratio(F.col(f"{prefix}_conv"), F.col(f"{prefix}_n"))


def two_proportion_z_test(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds the test to rows with ``control_n, control_conv, variant_n, variant_conv``.

    The statistic uses the pooled standard error, the interval the unpooled one. An empty
    arm, or no conversion at all, gives NULL statistics and counts as not significant.
    Significance is decided on the unrounded p-value.
    """
    n1, n2 = F.col("control_n").cast("double"), F.col("variant_n").cast("double")
    p1, p2 = F.col("_p1"), F.col("_p2")
    pooled = ratio(F.col("control_conv") + F.col("variant_conv"), F.col("control_n") + F.col("variant_n"))
    one = F.lit(1.0)
    pooled_error = F.sqrt(F.col("_pool") * (one - F.col("_pool")) * (F.try_divide(one, n1) + F.try_divide(one, n2)))
    own_error = F.sqrt(F.try_divide(p1 * (one - p1), n1) + F.try_divide(p2 * (one - p2), n2))
    margin = F.lit(normal.quantile(1 - alpha / 2)) * own_error
    difference = p2 - p1
    tested = (
        counts.withColumns({"_p1": _rate("control"), "_p2": _rate("variant"), "_pool": pooled})
        .withColumn("_z", F.try_divide(difference, pooled_error))
        .withColumn("_p", normal.two_sided_p(F.col("_z")))
    )
    return tested.withColumns(
        {
            "control_conv_rate": rounded(p1 * 100, 4),
            "variant_conv_rate": rounded(p2 * 100, 4),
            "absolute_lift_pp": rounded(difference * 100, 4),
            "relative_lift_pct": rounded(F.try_divide(difference, p1) * 100, 2),
            "z_statistic": rounded(F.col("_z"), 4),
            "p_value": rounded(F.col("_p"), 6, working_scale=12),
            "ci_95_lower_pp": rounded((difference - margin) * 100, 4),
            "ci_95_upper_pp": rounded((difference + margin) * 100, 4),
            "is_significant": F.coalesce(F.col("_p") < alpha, F.lit(False)),
            "alpha": F.lit(alpha),
        }
    ).drop("_p1", "_p2", "_pool", "_z", "_p")


def ab_test_result(sessions: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The test over all sessions, with the decision."""
    tested = two_proportion_z_test(ab_arm_counts(sessions), alpha).drop("control_conv", "variant_conv")
    return tested.withColumn("decision", F.when(F.col("is_significant"), SHIP).otherwise(CONTINUE))


def ab_segment_results(sessions: DataFrame, segment: str = "device", alpha: float = ALPHA) -> DataFrame:
    """The test per segment; a segment with fewer than 100 sessions in an arm is left out."""
    counts = ab_arm_counts(sessions, [segment]).where((F.col("control_n") >= MIN_ARM) & (F.col("variant_n") >= MIN_ARM))
    return (
        two_proportion_z_test(counts, alpha)
        .drop("control_conv", "variant_conv")
        .withColumnRenamed(segment, "segment")
        .orderBy(F.desc_nulls_last("relative_lift_pct"), "segment")
    )


def ab_daily_rolling_conversion(sessions: DataFrame) -> DataFrame:
    """Daily conversion per arm and its mean over seven days with sessions, NULL before the
    seventh. The window runs over one row per arm and day."""
    recent = Window.partitionBy("ab_variant").orderBy("date").rowsBetween(1 - ROLLING_ROWS, 0)
    rate = ratio(F.col("conversions") * 100, F.col("sessions"))
    return (
        sessions.groupBy("ab_variant", F.col("session_date").cast("date").alias("date"))
        .agg(F.sum("converted").alias("conversions"), F.count(F.lit(1)).alias("sessions"))
        .withColumn("_rate", rate)
        .select(
            "ab_variant",
            "date",
            "conversions",
            "sessions",
            rounded(F.col("_rate"), 4).alias("rate"),
            F.when(F.count("_rate").over(recent) == ROLLING_ROWS, rounded(F.avg("_rate").over(recent), 4)).alias(
                "rolling_rate"
            ),
        )
    )


def sample_size(baseline: Column, effect: Column, alpha: float = ALPHA, power: float = POWER) -> Column:
    """Sessions per arm needed to detect ``effect`` on top of ``baseline``."""
    p1, p2 = baseline, baseline + effect
    middle = (p1 + p2) / 2
    spread = F.lit(normal.quantile(1 - alpha / 2)) * F.sqrt(F.lit(2.0) * middle * (F.lit(1.0) - middle)) + F.lit(
        normal.quantile(power)
    ) * F.sqrt(p1 * (F.lit(1.0) - p1) + p2 * (F.lit(1.0) - p2))
    return F.ceil(F.try_divide(spread * spread, (p2 - p1) * (p2 - p1)))


def power_at(n: Column, baseline: Column, effect: Column, alpha: float = ALPHA) -> Column:
    """Power of a two-sided test with ``n`` sessions per arm."""
    p1, p2 = baseline, baseline + effect
    middle = (p1 + p2) / 2
    error = F.sqrt(F.try_divide(F.lit(2.0) * middle * (F.lit(1.0) - middle), n.cast("double")))
    z = F.try_divide(F.abs(p2 - p1), error) - F.lit(normal.quantile(1 - alpha / 2))
    return rounded(normal.cdf(z), 4)


def _segment_baselines(sessions: DataFrame, segment: str | None) -> DataFrame:
    """Control conversion rate per segment, rounded like the reported percentage; without a
    ``segment`` one row, ``all``, over all sessions."""
    name = F.lit(ALL_SESSIONS) if segment is None else F.col(segment)
    return ab_arm_counts(sessions, [segment] if segment else []).select(
        name.alias("segment"),
        "control_n",
        "variant_n",
        rounded(_rate("control"), 6).alias("baseline_rate"),
        (_rate("variant") - _rate("control")).alias("observed_effect"),
    )


def ab_required_sample(sessions: DataFrame, segment: str | None = "device", effect: float = EFFECT) -> DataFrame:
    return _segment_baselines(sessions, segment).select(
        "segment",
        "control_n",
        "baseline_rate",
        F.lit(effect).alias("min_detectable_effect"),
        sample_size(F.col("baseline_rate"), F.lit(effect)).alias("required_n"),
    )


def ab_observed_power(sessions: DataFrame, segment: str | None = "device", effect: float = EFFECT) -> DataFrame:
    """Power of the smaller arm to see ``effect``, per segment."""
    n = F.least("control_n", "variant_n")
    return _segment_baselines(sessions, segment).select(
        "segment",
        n.alias("n"),
        "baseline_rate",
        F.lit(effect).alias("effect"),
        power_at(n, F.col("baseline_rate"), F.lit(effect)).alias("power"),
    )


def ab_power_curve(sessions: DataFrame, segment: str | None = "device", effect: float = EFFECT) -> DataFrame:
    """Power over a range of arm sizes, per segment baseline."""
    sizes = F.sequence(F.lit(CURVE_START), F.lit(CURVE_STOP), F.lit(CURVE_STEP))
    return (
        _segment_baselines(sessions, segment)
        .select("segment", "baseline_rate", F.explode(sizes).alias("n"))
        .withColumn("power", power_at(F.col("n"), F.col("baseline_rate"), F.lit(effect)))
    )
