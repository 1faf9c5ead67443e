"""Z-score anomalies: seller velocity, refunds and daily volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import calendar
from bazaarlens.functions.numeric import ratio, rounded, with_totals, z_score
from bazaarlens.functions.quantiles import equal_width_histogram, exact_quantile

# Thresholds, weights and window sizes.
Z_THRESHOLD = 3.0
REFUND_Z_THRESHOLD = 2.5
RED_Z = 4
MIN_ORDERS = 20
RATE_WEIGHT, GMV_WEIGHT = 0.7, 0.3
ROLLING_DAYS, ROLLING_MIN = 14, 7
HISTOGRAM_BINS = 40
SCORE_QUANTILE = 0.95


def high_velocity_sellers(orders: DataFrame) -> DataFrame:
    """Seller weeks (Monday to Sunday) whose order count and value together lie more than
    three sample deviations above the mean, the two scores weighing the same."""
    weekly = orders.groupBy("seller_id", calendar.week_start(F.col("order_date")).alias("_start")).agg(
        F.count("order_id").alias("weekly_orders"), F.sum("gmv").alias("weekly_gmv")
    )
    n, gmv = F.col("weekly_orders"), F.col("weekly_gmv")
    weekly = with_totals(
        weekly,
        weekly,
        n_mu=F.avg(n),
        n_sigma=F.stddev_samp(n),
        gmv_mu=F.avg(gmv.cast("double")),
        gmv_sigma=F.stddev_samp(gmv.cast("double")),
    )
    return (
        weekly.withColumns(
            {
                "order_z": z_score(n, F.col("_all.n_mu"), F.col("_all.n_sigma")),
                "gmv_z": z_score(gmv, F.col("_all.gmv_mu"), F.col("_all.gmv_sigma")),
            }
        )
        .withColumn("combined_z", (F.col("order_z") + F.col("gmv_z")) / 2)
        .where(F.col("combined_z") > Z_THRESHOLD)
        .select(
            "seller_id",
            calendar.week_span_label(F.col("_start")).alias("week"),
            "weekly_orders",
            "weekly_gmv",
            "order_z",
            "gmv_z",
            "combined_z",
        )
        .orderBy(F.desc("combined_z"), "seller_id", "week")
    )


def refund_anomalies(orders: DataFrame) -> DataFrame:
    """Sellers (twenty orders or more) with a return rate far above the others; the score
    weighs the rate 0.7 and the volume 0.3."""
    sellers = (
        orders.groupBy("seller_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum("is_returned").alias("returned_orders"),
            F.sum("gmv").alias("total_gmv"),
        )
        .where(F.col("total_orders") >= MIN_ORDERS)
        .withColumn("return_rate", ratio(F.col("returned_orders"), F.col("total_orders")))
    )
    rate, gmv = F.col("return_rate"), F.col("total_gmv")
    sellers = with_totals(
        sellers,
        sellers,
        rate_mu=F.avg(rate),
        rate_sigma=F.stddev_samp(rate),
        gmv_mu=F.avg(gmv.cast("double")),
        gmv_sigma=F.stddev_samp(gmv.cast("double")),
    )
    score = F.lit(RATE_WEIGHT) * F.col("return_rate_z") + F.lit(GMV_WEIGHT) * F.col("gmv_z")
    return (
        sellers.withColumns(
            {
                "return_rate_z": z_score(rate, F.col("_all.rate_mu"), F.col("_all.rate_sigma")),
                "gmv_z": z_score(gmv, F.col("_all.gmv_mu"), F.col("_all.gmv_sigma")),
            }
        )
        .where(F.col("return_rate_z") > REFUND_Z_THRESHOLD)
        .withColumn("fraud_score", rounded(score, 4))
        .drop("_all")
        .orderBy(F.desc("fraud_score"), "seller_id")
    )


def gmv_spikes(orders: DataFrame) -> DataFrame:
    """Daily value against the mean and sample deviation of the last 14 days with orders,
    the day itself included; NULL until seven days are known. The window runs over one row
    per day."""
    recent = Window.orderBy("date").rowsBetween(1 - ROLLING_DAYS, 0)
    value = F.col("gmv").cast("double")
    enough = F.count("gmv").over(recent) >= ROLLING_MIN
    daily = orders.groupBy(F.col("order_date").cast("date").alias("date")).agg(F.sum("gmv").alias("gmv"))
    return (
        daily.withColumns(
            {
                "rolling_mean": F.when(enough, F.avg(value).over(recent)),
                "rolling_std": F.when(enough, F.stddev_samp(value).over(recent)),
            }
        )
        .withColumn("z_score", F.try_divide(value - F.col("rolling_mean"), F.col("rolling_std")))
        .withColumn("is_spike", F.coalesce(F.abs("z_score") > Z_THRESHOLD, F.lit(False)))
        .orderBy("date")
    )


def fraud_score_histogram(orders: DataFrame) -> DataFrame:
    """Forty equal bins of the fraud scores of flagged sellers, and their 0.95 quantile."""
    flagged = refund_anomalies(orders)
    threshold = exact_quantile(flagged, "fraud_score", SCORE_QUANTILE, digits=4).scalar()
    return equal_width_histogram(flagged, "fraud_score", HISTOGRAM_BINS, digits=4).withColumn("p95_score", threshold)


def top_velocity_sellers(orders: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most extreme seller weeks; red above four deviations, amber otherwise."""
    return (
        high_velocity_sellers(orders)
        .limit(n)
        .withColumn("severity", F.when(F.col("combined_z") > RED_Z, "red").otherwise("amber"))
    )


def anomaly_summary(orders: DataFrame) -> DataFrame:
    """Flagged seller weeks, flagged sellers and spike days, as one row."""
    velocity = high_velocity_sellers(orders).agg(F.count(F.lit(1))).scalar()
    refunds = refund_anomalies(orders).agg(F.count(F.lit(1))).scalar()
    return gmv_spikes(orders).agg(F.count_if("is_spike").alias("spike_days")).select(
        velocity.alias("velocity_events"), refunds.alias("refund_sellers"), "spike_days"
    )
