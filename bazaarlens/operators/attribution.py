"""Marketing report: channel revenue, trends, customer quality and the scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import ordered
from bazaarlens.functions.numeric import percent, ratio, rounded
from bazaarlens.session import staged

# Labels of the report.
SCALE_UP = "SCALE UP — High LTV + Strong Acquisition"
RETENTION = "RETENTION CHANNEL — Good LTV, Mostly Returning"
DISCOUNT = "REVIEW — High Discount Dependency"
MONITOR = "MONITOR"


def _history(orders: DataFrame) -> DataFrame:
    """Measures ``m`` per customer and channel over delivered orders. They are one struct,
    which no use prunes, so reports that need several figures aggregate the orders once."""
    measures = F.struct(
        F.count(F.lit(1)).alias("rows"),
        F.count("order_id").alias("orders"),
        F.sum("gmv").alias("gmv"),
        F.count("gmv").alias("valued"),
        F.sum("net_revenue").alias("revenue"),
        F.count("net_revenue").alias("priced"),
        F.sum("discount_amount").alias("discount"),
        F.min(F.struct("order_date", "order_id")).alias("first_here"),
    )
    return orders.where("is_delivered = 1").groupBy("customer_id", "channel").agg(measures.alias("m"))


def _revenue(history: DataFrame) -> DataFrame:
    everything = Window.partitionBy()
    return (
        history.groupBy("channel")
        .agg(
            F.sum("m.orders").alias("total_orders"),
            F.sum("m.gmv").alias("total_gmv"),
            F.sum("m.revenue").alias("net_revenue"),
            ratio(F.sum("m.gmv"), F.sum("m.valued")).alias("avg_order_value"),
            F.sum("m.discount").alias("total_discount"),
        )
        .withColumn("avg_discount_rate_pct", percent(F.col("total_discount"), F.col("total_gmv")))
        .withColumn("revenue_share_pct", percent(F.col("net_revenue"), F.sum("net_revenue").over(everything)))
    )


def channel_revenue(orders: DataFrame) -> DataFrame:
    """Last-touch revenue per channel. The share window runs over one row per channel."""
    return _revenue(_history(orders))


def monthly_channel_trend(orders: DataFrame) -> DataFrame:
    """Monthly revenue per channel, growth over the previous month with sales, and the
    mean of the last three such months."""
    months = Window.partitionBy("channel").orderBy("order_year", "order_month")
    previous = F.lag("revenue").over(months)
    rolling = months.rowsBetween(-2, 0)
    rolling_mean = ratio(F.sum("revenue").over(rolling), F.count("revenue").over(rolling))
    return (
        orders.where("is_delivered = 1")
        .groupBy("channel", "order_year", "order_month")
        .agg(F.count("order_id").alias("monthly_orders"), F.sum("net_revenue").alias("revenue"))
        .select(
            "channel",
            "order_year",
            "order_month",
            "monthly_orders",
            F.col("revenue").alias("monthly_net_revenue"),
            percent(F.col("revenue") - previous, previous).alias("mom_revenue_growth_pct"),
            rounded(rolling_mean, 2).alias("rolling_3m_avg_revenue"),
        )
    )


def acquisition_ltv(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Lifetime revenue of the customers each channel brought, customers without orders
    included. Orders are summed per customer before the join, so the join carries one row
    per customer and no customer is hot in it."""
    return _lifetime_value(customers, _history(orders))


def _lifetime_value(customers: DataFrame, history: DataFrame) -> DataFrame:
    spent = history.groupBy("customer_id").agg(
        F.sum("m.orders").alias("orders"), F.sum("m.revenue").alias("revenue"), F.sum("m.priced").alias("priced")
    )
    # A customer row that occurs more than once in a channel counts its orders as often.
    held = customers.groupBy("customer_id", "acquisition_channel").agg(F.count(F.lit(1)).alias("copies"))
    copies = F.col("copies")
    per_channel = (
        held.join(spent, "customer_id", "left")
        .groupBy("acquisition_channel")
        .agg(
            F.count("customer_id").alias("acquired_customers"),
            F.coalesce(F.sum(copies * F.col("orders")), F.lit(0)).alias("lifetime_orders"),
            F.sum(copies.cast("decimal(10,0)") * F.col("revenue")).alias("lifetime_revenue"),
            F.sum(copies * F.col("priced")).alias("priced"),
        )
    )
    ltv = ratio(F.col("lifetime_revenue"), F.col("acquired_customers"))
    return per_channel.select(
        "acquisition_channel",
        "acquired_customers",
        "lifetime_orders",
        "lifetime_revenue",
        rounded(ratio(F.col("lifetime_revenue"), F.col("priced")), 2).alias("avg_revenue_per_order"),
        rounded(ltv, 2).alias("ltv_per_customer"),
        rounded(ratio(F.col("lifetime_orders"), F.col("acquired_customers")), 2).alias("avg_orders_per_customer"),
        F.dense_rank().over(Window.orderBy(ltv.desc_nulls_last())).alias("ltv_rank"),
    )


def order_sequence(orders: DataFrame) -> DataFrame:
    """Position of each delivered order in its customer's history, by date then order id.
    Days are the chunks, and large days are cut once more, so one customer with very many
    orders is spread over tasks. The narrow rows are written once."""
    undated = F.lit("0001-01-01").cast("date")
    rows = orders.where("is_delivered = 1").select(
        "order_id", "customer_id", "channel", "order_date", F.coalesce(F.col("order_date").cast("date"), undated).alias("_day")
    )
    return ordered.row_number(
        staged(rows, "delivered-orders"),
        keys=["customer_id"],
        chunk=["_day"],
        chunk_order=[F.col("_day")],
        order=[F.col("order_date"), F.col("order_id")],
        out="order_seq",
    ).drop("_day")


def new_vs_returning(orders: DataFrame) -> DataFrame:
    """Customers whose first order came through the channel, customers with a later order
    through it, and all its customers; one customer can be in both groups.

    Orders collapse to one row per customer and channel on the map side, so the three
    distinct counts become plain sums and the window sees one row per channel. Orders
    without a customer count for none of them, but their channel keeps its row.
    """
    return _customer_mix(_history(orders))


def _customer_mix(history: DataFrame) -> DataFrame:
    history = history.select("customer_id", "channel", F.col("m.rows").alias("orders"), F.col("m.first_here").alias("first_here"))
    first = F.min("first_here").over(Window.partitionBy("customer_id"))
    known = F.col("customer_id").isNotNull()
    starts = (known & (F.col("first_here") == F.col("first_ever"))).cast("int")
    return (
        history.withColumn("first_ever", first)
        .select("channel", "customer_id", starts.alias("starts"), (known & (F.col("orders") > starts)).cast("int").alias("returns"))
        .groupBy("channel")
        .agg(
            F.sum("starts").alias("new_customers"),
            F.sum("returns").alias("returning_customers"),
            F.count("customer_id").alias("total_unique_customers"),
            percent(F.sum("starts"), F.count("customer_id")).alias("new_customer_pct"),
        )
    )


def channel_scorecard(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue, customer value and customer mix per channel, with a strategic signal. All
    three come from one aggregate of the orders."""
    history = _history(orders)
    value = _lifetime_value(customers, history).withColumnRenamed("acquisition_channel", "channel")
    mix = _customer_mix(history)
    rank, new = F.col("ltv_rank"), F.col("new_customer_pct")
    signal = (
        F.when((rank <= 2) & (new > 40), SCALE_UP)
        .when((rank <= 4) & (new < 25), RETENTION)
        .when(F.col("avg_discount_rate_pct") > 25, DISCOUNT)
        .otherwise(MONITOR)
    )
    return (
        _revenue(history)
        .join(value, "channel", "left")
        .join(mix, "channel", "left")
        .select(
            "channel",
            "total_orders",
            F.round("total_gmv", 0).alias("total_gmv"),
            F.round("net_revenue", 0).alias("net_revenue"),
            rounded(F.col("avg_order_value"), 2).alias("avg_order_value"),
            "revenue_share_pct",
            "avg_discount_rate_pct",
            "ltv_per_customer",
            "avg_orders_per_customer",
            "ltv_rank",
            "new_customer_pct",
            "returning_customers",
            signal.alias("strategic_signal"),
            F.col("net_revenue").alias("_exact"),
        )
        .orderBy(F.asc_nulls_last("ltv_rank"), F.desc("_exact"))
        .drop("_exact")
    )
