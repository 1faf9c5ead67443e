"""Scans of the logical tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.schemas import BY_NAME

#: Column of :func:`read_csv_with_rejects`: names of the columns whose text could not be read.
UNREADABLE = "_unreadable"


#: Header lines that are read at the same time.
HEADERS_AT_ONCE = 16


def files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of ``path`` (a file, folder or pattern) by the columns of their header lines.

    Of each file the first line is read. Files without any line are left out.
    """
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = list(pool.map(lambda file: tuple(spark.read.option("header", True).csv(file).columns), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, file in sorted(zip(headers, files, strict=True)):
        if header:
            groups.setdefault(header, []).append(file)
    return groups


def read_csv_with_rejects(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A raw CSV extract with header lines, columns found by name in any order.

    The header of each file decides for that file, so a folder may hold extracts whose
    columns are in another order or that have further columns; files with equal headers are
    scanned together. Every value is read as text and then converted to the declared type.
    A column that a header lacks is an error. A value that does not convert becomes NULL,
    and its column's name is listed in ``_unreadable``, which the audits count.
    """
    schema = BY_NAME[name]
    groups = files_by_header(spark, path)
    if not groups:
        raise ValueError(f"{name}: no header line in {path}")
    parts = []
    for header, files in groups.items():
        missing = [f.name for f in schema if f.name not in header]
        if missing:
            raise ValueError(f"{name}: the header of {files[0]} lacks {', '.join(missing)}")
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        parts.append(spark.read.schema(text).option("header", True).csv(files).select(schema.names))
    values = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema if not isinstance(f.dataType, T.StringType)}
    failed = [F.when(F.col(n).isNotNull() & v.isNull(), n) for n, v in values.items()]
    unreadable = F.filter(F.array(*failed), lambda n: n.isNotNull()).cast("array<string>")
    columns = [values.get(f.name, F.col(f.name)).alias(f.name) for f in schema]
    return reduce(DataFrame.union, parts).select(*columns, unreadable.alias(UNREADABLE))


def read_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The declared columns of :func:`read_csv_with_rejects`."""
    return read_csv_with_rejects(spark, name, path).drop(UNREADABLE)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the session catalog; later filters and projections reach its scan."""
    return spark.table(name)


def read_jdbc(
    spark: SparkSession, url: str, table: str, split_column: str, lower: str, upper: str, splits: int
) -> DataFrame:
    """A table of an external database, read by ``splits`` tasks over ranges of one column.

    The bounds only place the ranges; rows outside them are read by the first and last task.
    """
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=split_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=str(splits),
        )
        .load()
    )
