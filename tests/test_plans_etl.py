from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from bazaarlens import schemas
from bazaarlens.operators import quality
from bazaarlens.plans import etl, reports
from bazaarlens.session import shared_folder
from bazaarlens.sources import readers, sinks
from helpers import money, orders, payments, plan_of, sellers, when


def scans(df) -> list[str]:
    """The columns of every table scan that ran, reused exchanges and subqueries left out."""
    df.collect()
    found = []

    def items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def walk(node):
        name = node.nodeName()
        if name.startswith("Reused"):
            return
        if name.startswith("Scan parquet"):
            found.append(node.output().mkString(","))
        if name.startswith("AdaptiveSparkPlan"):
            below = [node.executedPlan()]
        else:
            below = [node.plan()] if "QueryStage" in name else items(node.children())
        for other in below + items(node.subqueries()):
            walk(other)

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("name", [n for n in reports.REPORTS if n != "clean_roundtrip"])
def test_no_report_plans_a_cross_or_nested_loop_join(spark, data_dir, name):
    plan = plan_of(reports.run(name, spark, data_dir))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["reconciliation_report", "seller_audit_list", "fraud_risk_register", "cohort_ltv_observed"])
def test_lines_are_read_and_deduplicated_once_per_report(spark, data_dir, name):
    assert sum(columns.startswith("l_") for columns in scans(reports.run(name, spark, data_dir))) == 1


def test_audit_list_and_threshold_share_one_aggregate(spark, data_dir):
    """The scores need the largest dispute, so the headers are read for that and for the totals."""
    read = scans(reports.run("seller_audit_list", spark, data_dir))
    assert sum(columns.startswith("o_") for columns in read) <= 2


def raw(spark):
    made = [{"order_id": "O1", "seller_id": "S1", "gmv": 600, "order_date": "2024-01-31 23:00:00"}, {"order_id": "O2", "seller_id": "S2", "gmv": 90, "order_date": "2024-02-01 01:00:00"}]
    order = orders(spark, made)
    customer = spark.createDataFrame([("C1", "KA", "18-24", "F", when("2024-06-01 00:00:00"), "email", 1)], schemas.CUSTOMERS)
    pay = payments(spark, [{"order_id": "O1", "actual_payout": 60}, {"order_id": "O2"}])
    return {"orders": order.union(order.limit(1)), "payments": pay, "customers": customer, "sellers": sellers(spark, ["S1", "S2"])}


def test_load_from_csv_to_clean_tables_and_summaries(spark, tmp_path):
    source = {}
    for name, df in raw(spark).items():
        sinks.write_csv(df, str(tmp_path / "raw" / name))
        source[name] = readers.read_csv(spark, name, str(tmp_path / "raw" / name))
        assert source[name].dtypes == df.dtypes
    for _ in range(2):  # a second load replaces the first
        paths, audits = etl.run_load(spark, source, str(tmp_path / "clean"), "2024-06-30")
    clean = readers.read_parquet(spark, paths["orders_clean"])
    assert clean.count() == 2 and {r.gmv_band for r in clean.collect()} == {"500-2K", "<500"}
    assert {str(r.order_date_month) for r in clean.collect()} == {"2024-01", "2024-02"}
    assert spark.read.parquet(paths["customers_clean"]).first().tenure_band == "<1M"
    summary = spark.read.option("header", True).csv(paths["monthly_revenue_summary"])
    assert {(r.order_month, r.total_orders) for r in summary.collect()} == {("1", "1"), ("2", "1")}
    disputes = spark.read.option("header", True).csv(paths["discrepancy_summary"]).collect()
    assert [(r.seller_id, r.total_discrepancy_amt) for r in disputes] == [("S1", "40.00")]
    assert [(r.row_count, r.duplicate_rows) for r in audits["orders_duplicates"].collect()] == [(3, 1)]
    assert audits["orders_ranges"].agg(F.sum("out_of_range")).first()[0] == 0
    assert audits["payments_rules"].agg(F.sum("violations")).first()[0] == 0


def test_csv_columns_are_found_by_name_and_bad_values_counted(spark, tmp_path):
    path = tmp_path / "spend.csv"
    path.write_text("date,channel,clicks,impressions,spend_inr\n2024-01-01,email,7,100,5.25\n2024-01-02,email,x,100,abc\n,email,1,,2\n")
    rows = readers.read_csv(spark, "marketing_spend", str(path)).orderBy("date").collect()
    assert [(r.clicks, r.spend_inr) for r in rows] == [(1, money(2)), (7, money("5.25")), (None, None)]
    kept = readers.read_csv_with_rejects(spark, "marketing_spend", str(path))
    audit = etl.raw_audits({n: kept for n in (*etl.KEYS, "spend")}, dict.fromkeys(etl.KEYS, 1))
    counts = {r.column_name: r.unreadable_count for r in audit["spend_unreadable"].collect()}
    assert counts["clicks"] == 1 and counts["spend_inr"] == 1 and counts["date"] == 0 and counts["impressions"] == 0
    path.write_text("date,channel,clicks,impressions\n")
    with pytest.raises(ValueError, match="spend_inr"):
        readers.read_csv(spark, "marketing_spend", str(path))


def test_each_file_of_a_folder_is_read_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "spend 100%"
    folder.mkdir()
    (folder / "a.csv").write_text("date,channel,clicks,impressions,spend_inr\n2024-01-01,email,7,100,5.25\n")
    (folder / "b.csv").write_text("clicks,spend_inr,note,date,channel,impressions\n8,6.50,hm,2024-01-02,search,200\n9,7,,2024-01-03,search,300\n")
    (folder / "c.csv").write_text("channel,date,impressions,clicks,spend_inr\nsocial,2024-01-04,400,ten,8\n")
    (folder / "empty.csv").write_text("")
    kept = readers.read_csv_with_rejects(spark, "marketing_spend", str(folder)).orderBy("date").collect()
    assert [(str(r.date), r.channel, r.clicks, r.impressions, r.spend_inr) for r in kept] == [
        ("2024-01-01", "email", 7, 100, money("5.25")),
        ("2024-01-02", "search", 8, 200, money("6.50")),
        ("2024-01-03", "search", 9, 300, money(7)),
        ("2024-01-04", "social", None, 400, money(8)),
    ]
    assert [r._unreadable for r in kept] == [[], [], [], ["clicks"]]
    assert sorted(map(len, readers.files_by_header(spark, str(folder)).values())) == [1, 1, 1]
    (folder / "d.csv").write_text("date,channel\n2024-01-05,email\n")
    with pytest.raises(ValueError, match="d.csv lacks"):
        readers.read_csv(spark, "marketing_spend", str(folder))


def files(folder) -> list[str]:
    return sorted(str(f.relative_to(folder)) for f in folder.rglob("*.parquet"))


def test_load_writes_each_clean_table_once_and_catalog_names_show_its_files(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS load_test")
    place = tmp_path / "clean"
    for loads in (1, 2):  # a second load moves the names to its own files
        paths, _ = etl.run_load(spark, raw(spark), str(place), "2024-06-30", database="load_test")
        assert sum("orders_clean" in f for f in files(place)) == 2 * loads  # one file a month
        found = spark.table("load_test.orders_clean")
        assert found.count() == 2 and set(found.inputFiles()) == set(spark.read.parquet(paths["orders_clean"]).inputFiles())
    assert not files(tmp_path.parent) or all("load_test.db" not in f for f in files(tmp_path.parent))
    assert spark.table("load_test.discrepancy_summary").first().seller_id == "S1"
    plan = plan_of(spark.table("load_test.orders_clean").where("order_date_month = '2024-02'").select("order_id"))
    assert "PartitionFilters: [isnotnull(order_date_month" in plan
    spark.sql("DROP DATABASE load_test CASCADE")


def test_a_load_that_fails_leaves_the_last_one(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "clean")
    spark.sql("CREATE DATABASE IF NOT EXISTS kept_test")
    etl.run_load(spark, raw(spark), place, "2024-06-30", database="kept_test")
    before = etl.published(spark, place)
    rows = {name: readers.read_parquet(spark, before[f"{name}_clean"]).collect() for name in etl.KEYS}
    written, write = [], sinks.write_clean

    def failing(df, path, *rest):
        if len(written) == 2:
            raise RuntimeError("lost")
        written.append(path)
        return write(df, path, *rest)

    monkeypatch.setattr(sinks, "write_clean", failing)
    with pytest.raises(RuntimeError, match="lost"):
        etl.run_load(spark, raw(spark), place, "2030-06-30", database="kept_test")
    assert len(written) == 2 and etl.published(spark, place) == before
    for name, kept in rows.items():
        assert readers.read_parquet(spark, before[f"{name}_clean"]).collect() == kept
        assert sorted(spark.table(f"kept_test.{name}_clean").collect(), key=str) == sorted(kept, key=str)
    monkeypatch.undo()
    paths, _ = etl.run_load(spark, raw(spark), place, "2030-06-30", database="kept_test")
    assert etl.published(spark, place) == paths != before
    spark.sql("DROP DATABASE kept_test CASCADE")


def test_observed_audits_equal_audits_of_the_written_tables(spark, tmp_path):
    source = raw(spark)
    bad = orders(spark, [{"order_id": "O3", "gmv": 900_000}, {"order_id": "O4", "gmv": 5, "discount_amount": 9}, {"order_id": "O5"}])
    bad = bad.withColumn("customer_id", F.when(F.col("order_id") != "O3", F.col("customer_id")))
    bad = bad.withColumn("gmv", F.when(F.col("order_id") != "O5", F.col("gmv")))
    source["orders"] = source["orders"].union(bad)
    unknown = payments(spark, [{"payment_id": "P9", "expected_payout": 0}]).withColumn("order_id", F.lit(None).cast("string"))
    source["payments"] = source["payments"].union(unknown)
    paths, found = etl.run_load(spark, source, str(tmp_path / "clean"), "2024-06-30")
    clean = {name: readers.read_parquet(spark, paths[f"{name}_clean"]) for name in etl.KEYS}
    assert found["orders_nulls"].collect() == quality.null_audit(clean["orders"], etl.CRITICAL["orders"], "orders").collect()
    assert found["payments_nulls"].collect() == quality.null_audit(clean["payments"], etl.CRITICAL["payments"], "payments").collect()
    assert found["orders_ranges"].collect() == quality.range_audit(clean["orders"], etl.ORDER_RANGES, "orders").collect()
    assert found["orders_rules"].collect() == quality.constraint_audit(clean["orders"], quality.order_rules()).collect()
    assert found["payments_rules"].collect() == quality.constraint_audit(clean["payments"], quality.payment_rules()).collect()
    assert {r.column_name: r.null_count for r in found["orders_nulls"].collect()} == {"order_id": 0, "customer_id": 1, "seller_id": 0, "gmv": 1}
    for name, key in etl.KEYS.items():
        assert found[f"{name}_duplicates"].collect() == quality.duplicate_audit(source[name], [key], name).collect()
    for name in ("orders_nulls", "orders_ranges", "orders_rules", "payments_nulls", "payments_rules"):
        assert scans(found[name]) == []


def test_load_of_empty_extracts(spark, tmp_path):
    source = {name: df.limit(0) for name, df in raw(spark).items()}
    paths, found = etl.run_load(spark, source, str(tmp_path / "clean"), "2024-06-30")
    assert readers.read_parquet(spark, paths["orders_clean"]).count() == 0
    assert [(r.null_count, r.null_share) for r in found["orders_nulls"].collect()] == [(0, 0.0)] * 4
    assert found["orders_duplicates"].first()[1:] == (0, 0, 0)


def test_clean_roundtrips_do_not_overwrite_each_other(spark, data_dir):
    one, two = (reports.run("clean_roundtrip", spark, data_dir) for _ in range(2))
    assert one.count() == two.count() > 0 and one.exceptAll(two).isEmpty()


@pytest.mark.parametrize(
    "name", ["top_discrepancies_per_seller", "seller_discrepancy_summary", "dispute_timeline", "reconciliation_report"]
)
def test_payouts_are_reduced_before_they_meet_sellers(spark, data_dir, name):
    """With nothing small enough to broadcast, an exchange of aggregated or limited rows lies below the seller join."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    try:
        plan = plan_of(reports.run(name, spark, data_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan[plan.index("SortMergeJoin [seller_id") :].split("\n")
    first = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_suppkey" in line or "Exchange hashpartitioning(seller_id" in line)
    assert any(mark in lines[first + 1] + lines[first + 2] for mark in ("partial_", "WindowGroupLimit", "Sort"))
    reduced = min(plan.index(mark) for mark in ("WindowGroupLimit", "partial_min", "partial_count", "partial_sum") if mark in plan)
    assert reduced < plan.index("l_orderkey", reduced)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from bazaarlens.operators import enrich, fraud_signals, summaries

    path = str(tmp_path / "orders")
    sinks.write_clean(enrich.enrich_orders(orders(spark, [{}, {"order_date": "2024-03-01 00:00:00"}])), path, "order_date", ("seller_id",))
    clean = readers.read_parquet(spark, path)
    plan = plan_of(summaries.monthly_revenue_summary(clean))
    assert "EqualTo(is_delivered,1)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "customer_id" not in schema and "seller_id" not in schema
    plan = plan_of(fraud_signals.seller_return_profile(clean, "2024-04-01"))
    assert "GreaterThanOrEqual(order_date" in plan


def test_table_sink_and_source(spark):
    df = spark.createDataFrame([(1, money(2))], "a int, b decimal(18,2)")
    for _ in range(2):
        sinks.write_table(df, "summary_test")
    assert readers.read_table(spark, "summary_test").collect() == df.collect()
    spark.sql("DROP TABLE summary_test")


class _Session:
    """Stands for a session on a cluster."""

    def __init__(self, folder, context_folder=None, master="yarn"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master
        self.context_folder = context_folder

    def getCheckpointDir(self):
        return self.context_folder


def test_shared_folder_is_the_checkpoint_setting():
    assert shared_folder(_Session("/shared/place/")) == "/shared/place"
    assert shared_folder(_Session(None, "hdfs:/set/in/code")) == "hdfs:/set/in/code"
    with pytest.raises(ValueError):
        shared_folder(_Session(None))
