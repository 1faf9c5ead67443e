"""Summary tables of the clean layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.numeric import mean, rounded


def monthly_revenue_summary(orders: DataFrame) -> DataFrame:
    return (
        orders.where("is_delivered = 1")
        .groupBy("order_year", "order_month")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum("gmv").alias("total_gmv"),
            F.sum("net_revenue").alias("total_net_revenue"),
            rounded(mean(F.col("gmv")), 2).alias("avg_order_value"),
            F.sum("discount_amount").alias("total_discount"),
        )
    )


def seller_performance(orders: DataFrame) -> DataFrame:
    """Delivered orders per seller.

    ``return_rate`` is taken over the delivered rows and is therefore always 0;
    ``return_rate_all`` is the share of returned rows among all orders of the seller.
    Sellers without a delivered order are left out.
    """
    delivered = F.col("is_delivered") == 1
    gmv = F.when(delivered, F.col("gmv"))
    return (
        orders.groupBy("seller_id")
        .agg(
            F.count(F.when(delivered, F.col("order_id"))).alias("total_orders"),
            F.sum(gmv).alias("total_gmv"),
            rounded(mean(gmv), 3).alias("avg_order_value"),
            rounded(mean(F.when(delivered, F.col("is_returned"))), 3).alias("return_rate"),
            rounded(mean(F.col("is_returned")), 3).alias("return_rate_all"),
        )
        .where("total_orders > 0")
    )


def discrepancy_summary(payments: DataFrame) -> DataFrame:
    return (
        payments.where("discrepancy_flag = 1")
        .groupBy("seller_id")
        .agg(
            F.count("payment_id").alias("disputed_payments"),
            F.sum("discrepancy_amt").alias("total_discrepancy_amt"),
            rounded(mean(F.col("discrepancy_pct")), 2).alias("avg_discrepancy_pct"),
        )
        .orderBy(F.desc("total_discrepancy_amt"), "seller_id")
    )
