"""The llm queries that SQL can express against their statements in DuckDB, value by value."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from bazaarlens.llm.queries import QUERIES
from bazaarlens.llm.sql import SQL

TABLES = ("documents", "embeddings", "pages", "conversations", "benchmark")


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, data_dir, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(data_dir, table)}.parquet'")
    df = QUERIES[name](spark, data_dir)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(cursor.fetchall())


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
