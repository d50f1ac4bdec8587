from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession


@pytest.fixture(scope="session")
def make_docs(spark: SparkSession):
    """``documents`` rows with a column more, whose name clashes with inner ones."""

    def build(rows: list[tuple]) -> DataFrame:
        rows = [(*r, None, None)[:3] for r in rows]
        full = [(d, t, "en", s, len(t or ""), 7, "x") for d, t, s in rows]
        schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, node BIGINT, tag STRING"
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def make_pages(spark: SparkSession):
    def build(rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame([(*r, 1) for r in rows], "page_id BIGINT, url STRING, html STRING, length INT")

    return build
