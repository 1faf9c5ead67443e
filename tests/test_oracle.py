"""Every report against its SQL statement in DuckDB, value by value."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from bazaarlens.plans import reports

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(data_dir, table)}.parquet'")
    return connection


def test_every_report_has_a_statement():
    assert set(reports.REPORTS) <= set(driver.queries()) and set(reports.REPORTS) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", list(reports.REPORTS))
def test_report_equals_sql(spark, duck, data_dir, name):
    df = driver.queries()[name](spark, data_dir)
    cursor = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    ours = Counter(tuple(row) for row in df.select(*columns).collect())
    assert ours == Counter(cursor.fetchall())


def test_reports_stand_without_the_training_data_part(tmp_path):
    """A copy of the repository without the optional package, its tests and the pipeline."""
    left_out = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py")
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as d; print(sorted(d.queries()) == sorted(d.oracle_sql()), *sorted(d.queries()))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    assert ran.stdout.split() == ["True", *sorted(reports.REPORTS)]
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
