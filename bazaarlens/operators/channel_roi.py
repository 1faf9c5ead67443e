"""Return on marketing spend per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import calendar
from bazaarlens.functions.numeric import mean, percent, ratio, rounded

# Report thresholds and texts.
STAR_ROI, WARN_ROI = 3, 1.5
STAR, WARN = "⭐", "⚠️"
ORGANIC, NO_VALUE = "organic", "—"


def channel_roi(orders: DataFrame, spend: DataFrame) -> DataFrame:
    """Last-touch revenue against spend. ``roi`` is revenue over spend; NULL when nothing
    was spent. Both inputs are aggregated before they meet, and the share windows run over
    one row per channel."""
    revenue = (
        orders.where("is_delivered = 1")
        .groupBy("channel")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum("gmv").alias("gmv"),
            F.sum("net_revenue").alias("net_revenue"),
            mean(F.col("gmv")).alias("avg_order_value"),
        )
    )
    cost = spend.groupBy("channel").agg(
        F.sum("spend_inr").alias("spent"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
    )
    spent, paid = F.col("total_spend"), F.col("total_spend") > 0
    everything = Window.partitionBy()
    all_spend = F.sum("total_spend").over(everything)
    zero = F.lit(0.0)
    return (
        revenue.join(cost, "channel", "left")
        .withColumn("total_spend", F.coalesce("spent", F.lit(0)).cast("decimal(28,2)"))
        .withColumns(
            {
                "roi": F.when(paid, rounded(ratio(F.col("net_revenue"), spent), 2)),
                "cpa": F.when(paid, rounded(ratio(spent, F.col("orders")), 2)).otherwise(zero),
                "ctr": F.when(
                    F.col("total_impressions") > 0,
                    percent(F.col("total_clicks"), F.col("total_impressions"), 3),
                ).otherwise(zero),
                "revenue_share": percent(F.col("net_revenue"), F.sum("net_revenue").over(everything)),
                "spend_share": F.when(all_spend > 0, percent(spent, all_spend)).otherwise(zero),
            }
        )
        .withColumn(
            "efficiency_score",
            F.when(F.col("roi") > 0, rounded(ratio(F.col("revenue_share"), F.col("spend_share")), 2)),
        )
        .select(
            "channel",
            "orders",
            "gmv",
            "net_revenue",
            "avg_order_value",
            "total_spend",
            "total_impressions",
            "total_clicks",
            "roi",
            "cpa",
            "ctr",
            "revenue_share",
            "spend_share",
            "efficiency_score",
        )
        .orderBy(F.desc_nulls_last("roi"), "channel")
    )


def weekly_channel_revenue(orders: DataFrame) -> DataFrame:
    """Delivered net revenue per Monday-to-Sunday week and channel."""
    return (
        orders.where("is_delivered = 1")
        .groupBy(calendar.week_start(F.col("order_date")).alias("week"), "channel")
        .agg(F.sum("net_revenue").alias("net_revenue"))
    )


def top_channel_weekly_trend(orders: DataFrame, spend: DataFrame, n: int = 4) -> DataFrame:
    """The weekly trend of the ``n`` channels with the best ROI."""
    best = channel_roi(orders, spend).limit(n).select("channel")
    return weekly_channel_revenue(orders).join(best, "channel", "left_semi").select("week", "channel", "net_revenue")


def roi_recommendation(orders: DataFrame, spend: DataFrame) -> DataFrame:
    """Star and warning flags, and which channel to expand or to review. NULL ROI gets neither."""
    known = F.col("roi").isNotNull()
    from_best = F.row_number().over(Window.orderBy(F.desc_nulls_last("roi"), "channel"))
    from_worst = F.row_number().over(Window.orderBy(F.asc_nulls_last("roi"), F.desc("channel")))
    return channel_roi(orders, spend).select(
        "channel",
        "roi",
        "cpa",
        F.when(F.col("roi") >= STAR_ROI, STAR).when(F.col("roi") < WARN_ROI, WARN).otherwise("").alias("flag"),
        known.alias("has_roi"),
        (F.col("total_spend") > 0).alias("has_spend"),
        (F.col("cpa") > 0).alias("has_cpa"),
        (known & (from_best == 1)).alias("is_best"),
        (known & (from_worst == 1)).alias("is_worst"),
    )


def channel_scorecard_text(orders: DataFrame, spend: DataFrame) -> DataFrame:
    """Scorecard cells as text."""

    def one_decimal(name: str) -> Column:
        return F.format_string("%.1f", F.round(F.col(name).cast("decimal(18,4)"), 1).cast("double"))

    whole = F.format_number(F.round(F.col("cpa").cast("decimal(28,4)"), 0), 0)
    return channel_roi(orders, spend).select(
        "channel",
        F.replace("channel", F.lit("_"), F.lit("\n")).alias("label"),
        F.when(F.col("roi").isNotNull(), F.concat(one_decimal("roi"), F.lit("x"))).otherwise(ORGANIC).alias("roi_text"),
        F.when(F.col("cpa") > 0, F.concat(F.lit("₹"), whole)).otherwise(NO_VALUE).alias("cpa_text"),
        F.concat(one_decimal("revenue_share"), F.lit("%")).alias("revenue_share_text"),
    )
