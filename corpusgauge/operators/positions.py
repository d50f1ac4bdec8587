"""Gapless numbers of rows in an order, and packing of ordered lines into files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.session import stored

#: Lines of one packed file, where the caller names no number.
LINES_PER_FILE = 100_000


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """Add ``out``: the place, from 1, of every row among those of equal ``keys`` in ``order``.

    No task numbers a whole key.  Rows are range-partitioned by keys and order and written
    with their partition, which is monotone in the order.  Counts of rows by key and
    partition are added up first, one narrow row for each; within a partition rows are
    counted by a window, so a key that holds all rows is spread like any other.

    Rows equal in keys and order get their places in any order among themselves.  A null
    comes first, and null keys are one key.  An empty table gives no rows.  Columns other
    than ``out``, which is replaced, are kept.
    """
    kept = [c for c in df.columns if c != out]
    part, before = _fresh(df, "part"), _fresh(df, "before")
    ranged = df.select(*kept).repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id())
    # written, so that every use of the partitions sees the same ones
    ranged = stored(ranged, "ranged")
    names = [_fresh(df, f"key{i}") for i in range(len(keys))]
    counted = ranged.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(part).alias(out))
    earlier = Window.partitionBy(*names).orderBy(out).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.agg(F.count(F.lit(1)).alias(before))
    counted = counted.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    within = Window.partitionBy(*keys, part).orderBy(*order)
    place = _fresh(df, "place")
    rows = ranged.withColumn(place, F.row_number().over(within))
    same = F.col(part) == F.col(out)
    for key, name in zip(keys, names, strict=True):
        same = same & F.col(key).eqNullSafe(F.col(name))
    return rows.join(counted, same).select(*kept, (F.col(place) + F.col(before)).cast("long").alias(out))


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def packed_lines(
    lines: DataFrame, key: str, order: Sequence[str], per_file: int = LINES_PER_FILE
) -> DataFrame:
    """``key, file, line_no, line``: where each line of each report lies in packed files.

    Reports follow each other by ``key``, their lines by ``order``; every ``per_file`` lines
    make a file, from 0, and ``line_no`` counts from 1 in it.  So small reports share a file
    and a large one goes on in the next.  A line that holds line breaks counts as several.
    """
    piece = F.posexplode(F.split("line", "\n", -1)).alias("__piece", "line")
    others = [c for c in dict.fromkeys((key, *order)) if c != "line"]
    pieces = lines.filter("line IS NOT NULL").select(*others, piece)
    placed = with_positions(pieces, [], [*others, "__piece"])
    at = F.col("position") - 1
    return placed.select(
        key,
        F.floor(at / F.lit(per_file)).cast("long").alias("file"),
        (F.pmod(at, F.lit(per_file)) + 1).cast("long").alias("line_no"),
        "line",
    )


def packed_index(packed: DataFrame, key: str) -> DataFrame:
    """``key, file, first_line, n_lines`` of every file that has lines of a report."""
    return packed.groupBy(key, "file").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines")
    )
