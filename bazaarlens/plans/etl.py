"""The batch load: raw extracts to clean tables to summary tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators import enrich, quality, summaries
from bazaarlens.sources import sinks
from bazaarlens.sources.readers import UNREADABLE

# Key, month column and clustering of each clean table.
KEYS = {"orders": "order_id", "payments": "payment_id", "customers": "customer_id", "sellers": "seller_id"}
MONTH_OF = {"orders": "order_date", "payments": "settlement_date"}
CLUSTER_BY = {"orders": ("seller_id", "category"), "payments": ("seller_id",)}
# Critical columns and allowed ranges.
CRITICAL = {
    "orders": ("order_id", "customer_id", "seller_id", "gmv"),
    "payments": ("payment_id", "order_id", "seller_id"),
}
ORDER_RANGES = {"gmv": (0, 200_000), "discount_rate": (0, 1)}


def clean_tables(raw: Mapping[str, DataFrame], as_of: str) -> dict[str, DataFrame]:
    """Deduplicated and enriched tables. Among copies of a key the smallest by the other
    columns stays, which is the same row in every run."""
    unique = {}
    for name, key in KEYS.items():
        others = [c for c in raw[name].columns if c != key]
        unique[name] = quality.drop_duplicate_keys(raw[name], [key], others)
    return {
        "orders": enrich.enrich_orders(unique["orders"]),
        "payments": enrich.enrich_payments(unique["payments"]),
        "customers": enrich.enrich_customers(unique["customers"], as_of),
        "sellers": unique["sellers"],
    }


RULES = {"orders": quality.order_rules, "payments": quality.payment_rules}
RANGES = {"orders": ORDER_RANGES}


def clean_counts(name: str) -> dict[str, Column]:
    """All figures that the audits need of one clean table, as aggregates of its rows."""
    counts = quality.null_counts(CRITICAL.get(name, ()))
    return counts | quality.range_counts(RANGES.get(name, {})) | quality.rule_counts(RULES.get(name, dict)())


def audits(spark: SparkSession, figures: Mapping[str, Mapping[str, int]]) -> dict[str, DataFrame]:
    """Quality reports on the clean tables from their figures; they warn and reject nothing."""
    rows = {name: _one_row(spark, found) for name, found in figures.items()}
    reports = {f"{name}_nulls": quality.null_report(rows[name], columns, name) for name, columns in CRITICAL.items()}
    reports |= {f"{name}_ranges": quality.range_report(rows[name], limits, name) for name, limits in RANGES.items()}
    return reports | {f"{name}_rules": quality.constraint_report(rows[name], rules()) for name, rules in RULES.items()}


def _one_row(spark: SparkSession, figures: Mapping[str, int]) -> DataFrame:
    return spark.createDataFrame([tuple(figures.values())], ", ".join(f"`{n}` long" for n in figures))


def raw_audits(raw: Mapping[str, DataFrame], kept: Mapping[str, int]) -> dict[str, DataFrame]:
    """Duplicate keys of each extract, and values that could not be read where the reader
    kept track of them. ``kept`` are the rows of the clean tables, one for each key, so an
    extract needs no more than to be counted."""
    reports = {}
    for name in KEYS:
        counted = raw[name].agg(F.count(F.lit(1)).alias("row_count")).withColumn("distinct_keys", F.lit(kept[name]).cast("long"))
        reports[f"{name}_duplicates"] = quality.duplicate_report(counted, name)
    for name, df in raw.items():
        if UNREADABLE in df.columns:
            columns = [c for c in df.columns if c != UNREADABLE]
            reports[f"{name}_unreadable"] = quality.unreadable_audit(df, columns, UNREADABLE, name)
    return reports


def published(spark: SparkSession, folder: str) -> dict[str, str]:
    """The paths of the tables of the last complete load below ``folder``."""
    last = spark.read.schema(LOADS).json(f"{folder}/loads").orderBy(F.desc("number")).first()
    return {t.name: t.path for t in last.tables}


LOADS = "number long, tables array<struct<name: string, path: string>>"


def _publish(spark: SparkSession, folder: str, paths: Mapping[str, str]) -> None:
    """Adds a record of a complete load; until it is there, readers get the load before."""
    record = (time.time_ns(), [(name, path) for name, path in paths.items()])
    spark.createDataFrame([record], LOADS).coalesce(1).write.mode("append").json(f"{folder}/loads")


def run_load(
    spark: SparkSession, raw: Mapping[str, DataFrame], folder: str, as_of: str, database: str | None = None
) -> tuple[dict[str, str], dict[str, DataFrame]]:
    """Writes clean tables and summaries below ``folder``; returns their paths and the audits.

    Every load writes to a folder of its own, each table once, and is published when all of it
    is there: :func:`published` gives the paths of the last complete load. A load that
    fails leaves the tables of the load before as they were. With ``database`` every clean
    table and summary also gets a catalog name there, which then stands for the new files.

    The audits of the clean tables come from figures that the writes gather. The summaries
    read the written tables. That computes the load once without holding it in executor
    memory, and a lost executor costs only its running tasks.
    """
    version = uuid.uuid4().hex[:12]
    place = f"{folder}/load-{version}"
    paths, written, figures = {}, {}, {}
    for name, df in clean_tables({n: d.drop(UNREADABLE) for n, d in raw.items()}, as_of).items():
        path = paths[f"{name}_clean"] = f"{place}/{name}_clean"
        figures[name] = sinks.write_clean(df, path, MONTH_OF.get(name), CLUSTER_BY.get(name, ()), clean_counts(name))
        written[name] = spark.read.parquet(path)
    reports = {
        "monthly_revenue_summary": summaries.monthly_revenue_summary(written["orders"]),
        "seller_performance": summaries.seller_performance(written["orders"]),
        "discrepancy_summary": summaries.discrepancy_summary(written["payments"]),
    }
    files = dict(paths)
    for name, df in reports.items():
        files[name] = f"{place}/{name}_rows"
        df.write.parquet(files[name])
        paths[name] = f"{place}/{name}"
        sinks.write_csv(spark.read.parquet(files[name]), paths[name])
    _publish(spark, folder, paths)
    for name, path in files.items() if database else ():
        sinks.show_files(spark, f"{database}.{name}", path, version)
    gates = raw_audits(raw, {name: found["row_count"] for name, found in figures.items()})
    return paths, gates | audits(spark, figures)
