"""Row generation from computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_items(
    df: DataFrame, keep: list[str], items: Column, index: str, item: str = "item"
) -> DataFrame:
    """``keep`` columns, position and item, one row per array element.

    A plain explode makes the optimizer infer ``size(items) > 0`` and push it below
    the projection that computes ``items``, so the regex work would be done twice.
    The outer form infers nothing; rows of empty arrays are dropped by position.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(index, item)).filter(
        F.col(index).isNotNull()
    )
