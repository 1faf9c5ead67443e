"""Logical tables. Readers use these schemas, so nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
PERCENTAGE = T.DecimalType(5, 2)

# Names, order, types and nullability of the columns.
ORDERS = T.StructType(
    [
        T.StructField("order_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("seller_id", T.StringType(), False),
        T.StructField("order_date", T.TimestampType(), False),
        T.StructField("category", T.StringType(), True),
        T.StructField("gmv", MONEY, True),
        T.StructField("discount_amount", MONEY, True),
        T.StructField("shipping_fee", MONEY, True),
        T.StructField("status", T.StringType(), True),
        T.StructField("payment_method", T.StringType(), True),
        T.StructField("channel", T.StringType(), True),
        T.StructField("net_revenue", MONEY, True),
    ]
)
SELLERS = T.StructType(
    [
        T.StructField("seller_id", T.StringType(), False),
        T.StructField("seller_name", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("state", T.StringType(), True),
        T.StructField("tier", T.StringType(), True),
        T.StructField("joined_date", T.DateType(), True),
        T.StructField("commission_pct", PERCENTAGE, True),
        T.StructField("is_active", T.IntegerType(), True),
    ]
)
CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("state", T.StringType(), True),
        T.StructField("age_group", T.StringType(), True),
        T.StructField("gender", T.StringType(), True),
        T.StructField("registration_date", T.TimestampType(), True),
        T.StructField("acquisition_channel", T.StringType(), True),
        T.StructField("is_prime", T.IntegerType(), True),
    ]
)
PAYMENTS = T.StructType(
    [
        T.StructField("payment_id", T.StringType(), False),
        T.StructField("order_id", T.StringType(), False),
        T.StructField("seller_id", T.StringType(), False),
        T.StructField("expected_payout", MONEY, True),
        T.StructField("actual_payout", MONEY, True),
        T.StructField("discrepancy_flag", T.IntegerType(), True),
        T.StructField("discrepancy_amt", MONEY, True),
        T.StructField("settlement_date", T.TimestampType(), True),
        T.StructField("settlement_cycle", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
    ]
)
MARKETING_SPEND = T.StructType(
    [
        T.StructField("date", T.DateType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("spend_inr", MONEY, True),
        T.StructField("impressions", T.LongType(), True),
        T.StructField("clicks", T.LongType(), True),
    ]
)
SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType(), True),
        T.StructField("session_date", T.TimestampType(), True),
        T.StructField("channel", T.StringType(), True),
        T.StructField("device", T.StringType(), True),
        T.StructField("ab_variant", T.StringType(), True),
        T.StructField("pages_viewed", T.IntegerType(), True),
        T.StructField("session_duration_sec", T.IntegerType(), True),
        T.StructField("converted", T.IntegerType(), True),
        T.StructField("bounce", T.IntegerType(), True),
    ]
)

BY_NAME = {
    "orders": ORDERS,
    "sellers": SELLERS,
    "customers": CUSTOMERS,
    "payments": PAYMENTS,
    "marketing_spend": MARKETING_SPEND,
    "sessions": SESSIONS,
}
