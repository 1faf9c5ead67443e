"""The benchmark star schema seen as the logical commerce tables.

Ids keep their integer type; the operators only compare them. All derived values use
integer and decimal arithmetic, so another engine reproduces them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.numeric import MONEY
from bazaarlens.operators import enrich, quality

# Fixed values of the mapping.
CHANNELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
TIERS = ("Gold", "Silver", "Bronze", "Platinum")
AGE_GROUPS = ("18-24", "25-34", "35-44", "45-54", "55+")
GENDERS = ("M", "F", "Other")
DEVICES = ("mobile", "desktop", "tablet")
VARIANTS = ("control", "variant_b")
PAYMENT_METHODS = {"F": "UPI", "O": "Credit Card", "P": "COD"}
LINE_KEY = ("l_orderkey", "l_linenumber")
LINE_TIEBREAK = ("l_suppkey", "l_partkey", "l_extendedprice")
LINE_VALUES = ("l_quantity", "l_discount", "l_returnflag", "l_linestatus")


def _pick(index: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def _days_after(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


class StarSchemaTables:
    """Logical tables over one directory of star-schema Parquet files."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def scan(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{table}.parquet")

    def raw_lines(self) -> DataFrame:
        return self.scan("lineitem")

    def lines(self) -> DataFrame:
        """Order lines, one per key. The duplicate copies go before any join sees them."""
        lines = self.raw_lines().select(*LINE_KEY, *LINE_TIEBREAK, *LINE_VALUES)
        return quality.drop_duplicate_keys(lines, LINE_KEY, LINE_TIEBREAK)

    def _order_id(self) -> Column:
        return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))

    def _status(self) -> Column:
        flag, line = F.col("l_returnflag"), F.col("l_linestatus")
        return (
            F.when((flag == "R") & (line == "F"), "returned")
            .when((flag == "R") & (line == "O"), "cancelled")
            .when((flag == "N") & (line == "O"), "pending")
            .otherwise("delivered")
        )

    def _money_columns(self) -> dict[str, Column]:
        gmv = F.col("l_extendedprice").cast(MONEY)
        return {
            "gmv": gmv,
            "discount_amount": F.round(gmv * F.col("l_discount").cast("decimal(4,2)"), 2).cast(MONEY),
            "shipping_fee": F.col("l_quantity").cast(MONEY),
        }

    def _lookup(self, df: DataFrame, key: str, table: str, table_key: str, value: str, out: str) -> DataFrame:
        """Left join to one value of a dimension. Grouping by the key makes it provably
        unique, so Catalyst drops the whole join from plans that do not use the value."""
        dimension = self.scan(table).groupBy(table_key).agg(F.min(value).alias(out))
        return df.join(dimension, F.col(key) == F.col(table_key), "left")

    def raw_orders(self) -> DataFrame:
        """Orders as extracted, one row per key."""
        headers = self.scan("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        rows = self.lines().join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
        rows = self._lookup(rows, "l_partkey", "part", "p_partkey", "p_type", "category")
        columns = {
            "order_id": self._order_id(),
            "customer_id": F.col("o_custkey"),
            "seller_id": F.col("l_suppkey"),
            "order_date": F.col("o_orderdate").cast("timestamp"),
            "category": F.col("category"),
        }
        methods = F.create_map(*[F.lit(x) for pair in PAYMENT_METHODS.items() for x in pair])
        columns |= self._money_columns()
        columns |= {
            "status": self._status(),
            "payment_method": methods[F.col("o_orderstatus")],
            "channel": _pick(F.substring("o_orderpriority", 1, 1).cast("int") - 1, CHANNELS),
        }
        return rows.select(*[c.alias(n) for n, c in columns.items()])

    def orders(self) -> DataFrame:
        return enrich.enrich_orders(self.raw_orders())

    def raw_payments(self) -> DataFrame:
        """One payout per delivered order: expected and actual amount, and settlement day."""
        headers = self.scan("orders").select("o_orderkey", "o_orderdate")
        delivered = self.lines().where(self._status() == "delivered")
        money = self._money_columns()
        net = money["gmv"] - money["discount_amount"] + money["shipping_fee"]
        keep = (F.lit(95) - F.col("l_suppkey") % 16).cast("decimal(5,0)")
        expected = F.round(net * keep * F.lit(0.01).cast("decimal(3,2)"), 2).cast(MONEY)
        short = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_suppkey")) % 33 == 0
        paid = (F.lit(40) + F.col("l_orderkey") % 60).cast("decimal(5,0)")
        actual = F.when(
            short, F.round(F.col("expected_payout") * paid * F.lit(0.01).cast("decimal(3,2)"), 2)
        ).otherwise(F.col("expected_payout"))
        settled = F.date_add(
            F.col("o_orderdate").cast("date"),
            (F.lit(7) + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 15).cast("int"),
        )
        return (
            delivered.join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumn("expected_payout", expected)
            .select(
                F.concat(F.lit("PAY-"), self._order_id()).alias("payment_id"),
                self._order_id().alias("order_id"),
                F.col("l_suppkey").alias("seller_id"),
                "expected_payout",
                actual.cast(MONEY).alias("actual_payout"),
                settled.cast("timestamp").alias("settlement_date"),
            )
        )

    def payments(self) -> DataFrame:
        return enrich.enrich_payments(enrich.derive_discrepancy(self.raw_payments()))

    def sellers(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self._lookup(self.scan("supplier"), "s_nationkey", "nation", "n_nationkey", "n_name", "state").select(
            key.alias("seller_id"),
            F.col("s_name").alias("seller_name"),
            _pick(key % 6, CATEGORIES).alias("category"),
            "state",
            _pick(key % 4, TIERS).alias("tier"),
            _days_after("1992-01-01", key % 900).alias("joined_date"),
            (key % 16 + 5).cast("decimal(5,2)").alias("commission_pct"),
            (F.col("s_acctbal") >= 0).cast("int").alias("is_active"),
        )

    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        registered = _days_after("1995-01-01", key % 2400).cast("timestamp") + F.make_dt_interval(
            hours=(key % 24).cast("int")
        )
        return self._lookup(self.scan("customer"), "c_nationkey", "nation", "n_nationkey", "n_name", "state").select(
            key.alias("customer_id"),
            "state",
            _pick(key % 5, AGE_GROUPS).alias("age_group"),
            _pick(key % 3, GENDERS).alias("gender"),
            registered.alias("registration_date"),
            F.col("c_mktsegment").alias("acquisition_channel"),
            (key % 3 == 0).cast("int").alias("is_prime"),
        )

    def sessions(self) -> DataFrame:
        event = F.col("event_id")
        return self.scan("events").select(
            event.alias("session_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").cast("timestamp").alias("session_date"),
            _pick(event % 5, CHANNELS).alias("channel"),
            _pick(event % 3, DEVICES).alias("device"),
            _pick(event % 2, VARIANTS).alias("ab_variant"),
            (event % 17 + 1).cast("int").alias("pages_viewed"),
            F.floor("value").cast("int").alias("session_duration_sec"),
            (F.col("event_type") == "purchase").cast("int").alias("converted"),
            (F.col("event_type") == "error").cast("int").alias("bounce"),
        )

    def marketing_spend(self) -> DataFrame:
        """Daily spend per channel. The first channel spends nothing, like an organic one."""
        slot = F.col("event_id") % 5
        return (
            self.scan("events")
            .groupBy(F.col("ts").cast("date").alias("date"), slot.alias("slot"))
            .agg(
                F.sum(F.col("value").cast(MONEY)).alias("value"),
                F.count(F.lit(1)).alias("events"),
                F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"),
            )
            .select(
                "date",
                _pick(F.col("slot"), CHANNELS).alias("channel"),
                (F.col("value") * F.col("slot").cast("decimal(3,0)") * F.lit(2000)).cast(MONEY).alias("spend_inr"),
                (F.col("events") * 100).alias("impressions"),
                "clicks",
            )
        )

    def purchases(self) -> DataFrame:
        """Purchase events as orders. Order headers carry no time of day, these do."""
        return (
            self.scan("events")
            .where(F.col("event_type") == "purchase")
            .select(
                F.col("event_id").alias("order_id"),
                F.col("user_id").alias("customer_id"),
                (F.col("user_id") % 100).alias("seller_id"),
                F.col("ts").cast("timestamp").alias("order_date"),
                (F.col("value").cast(MONEY) * 100).cast(MONEY).alias("gmv"),
            )
        )
