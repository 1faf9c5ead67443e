"""Writers for clean tables, summaries and report extracts, and the catalog entries over written files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_clean(
    df: DataFrame,
    path: str,
    month_of: str | None = None,
    cluster_by: Sequence[str] = (),
    figures: Mapping[str, Column] | None = None,
) -> dict[str, int]:
    """Parquet, one directory per month of ``month_of``, rows of a file ordered by ``cluster_by``.

    The rebalance hint lets AQE give a large month many tasks and put small months
    together, so neither a hot month nor thousands of tiny files appear. Row-group
    statistics on the clustering columns serve later filters.

    ``figures`` are aggregates of the written rows; the write gathers them on its way and
    they are returned by name. They are counted in the tasks that write, each of which
    counts once however often it is retried.
    """
    if month_of is not None:
        month = f"{month_of}_month"
        df = df.withColumn(month, F.date_format(month_of, "yyyy-MM")).hint("rebalance", month)
        cluster_by = (month, *cluster_by)
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    observed = Observation(f"figures-{uuid.uuid4().hex}")
    counts = {"_rows": F.count(F.lit(1)), **(figures or {})}
    writer = df.observe(observed, *[c.alias(n) for n, c in counts.items()]).write.mode("overwrite")
    if month_of is not None:
        writer = writer.partitionBy(month)
    writer.parquet(path)
    found = dict(observed.get) or dict.fromkeys(counts, 0)  # nothing is observed of a plan without rows
    if month_of is not None and not found["_rows"]:
        df.limit(0).write.mode("overwrite").parquet(path)  # a file with the columns, so the table can be read
    return {n: found[n] for n in figures or ()}


def show_files(spark: SparkSession, name: str, path: str, version: str) -> None:
    """Lets the catalog name ``name`` stand for the Parquet files in ``path``, which are not copied.

    The files get a table of their own, ``name__version``, with partitions and size; then
    the view ``name`` is pointed at it in one step, so readers see the files of one version
    or of the other. Tables of earlier versions stay until they are dropped.
    """
    table = f"{name}__{version}"
    spark.catalog.createTable(table, path, "parquet")
    if any(c.isPartition for c in spark.catalog.listColumns(table)):
        spark.catalog.recoverPartitions(table)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS NOSCAN")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {table}")


def write_table(df: DataFrame, name: str) -> None:
    """A catalog table, for the summary layer."""
    df.write.mode("overwrite").saveAsTable(name)


def write_csv(df: DataFrame, path: str) -> None:
    """A report extract with a header line. Missing values stay empty."""
    df.write.mode("overwrite").option("header", True).csv(path)
