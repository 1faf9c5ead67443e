from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        names = ("row", "id", "size", "shard", "slot", "kept", "component_id", "bucket", "hash", "start", "length", "score")
        from pyspark.sql import functions as F

        return df.withColumns({n: F.lit("x") for n in names})

    return make
