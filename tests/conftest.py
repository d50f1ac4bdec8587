from __future__ import annotations

from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession

from corpusgauge.session import build_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def texts(spark: SparkSession) -> Callable[[list[str]], DataFrame]:
    """``idx, text`` of a list of strings."""

    def build(values: list[str]) -> DataFrame:
        return spark.createDataFrame(list(enumerate(values)), "idx INT, text STRING")

    return build


@pytest.fixture(scope="session")
def make_files(spark: SparkSession) -> Callable[..., DataFrame]:
    """A ``files`` table from ``{path: content}``; sizes follow from the contents."""

    def build(contents: dict[str, str], repo_id: str = "r", sizes: dict[str, int] | None = None) -> DataFrame:
        rows = [
            (repo_id, path, content, (sizes or {}).get(path, len(content.encode())))
            for path, content in contents.items()
        ]
        return spark.createDataFrame(
            rows, "repo_id STRING, path STRING, content STRING, size_bytes BIGINT"
        )

    return build
