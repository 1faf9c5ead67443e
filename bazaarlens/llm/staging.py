"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch between Spark and Python. Texts are long, so the default of 10,000 rows is too much memory.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Session settings of the queries and the pipeline: UTC, short Arrow batches, a shared folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ensure_shared_folder(spark)


def ensure_shared_folder(spark: SparkSession) -> None:
    """Sets a checkpoint folder where none is set, as in tests and local trials."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bazaarlens-"))


def _folder(spark: SparkSession) -> str:
    ensure_shared_folder(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` below the shared folder under a fresh name and returns the written table.

    This cuts the lineage: a lost executor costs its running tasks and never the stages
    before, and values drawn per row (row ids, partition ids) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def hashed_fraction(key: Column, fraction: float, seed: int) -> Column:
    """True for about ``fraction`` of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, fraction) * (1 << 30)))
