"""DataFrame helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of a text, as a Java and DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


def with_running_sum(
    df: DataFrame,
    value: Column,
    out: str,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the same ``keys``.

    ``bucket`` must be monotone in ``order`` within a key.  Sums of whole buckets are
    added up first (one narrow row for each bucket), so that a window never holds
    more than one bucket of one key, whatever share of the rows a key has.
    """
    slot, amount, base = "__bucket", "__value", "__base"
    rows = df.withColumn(slot, bucket).withColumn(amount, value)
    totals = rows.groupBy(*keys, slot).agg(F.sum(amount).alias(amount))
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    # other names on this side: both sides come from the same rows
    names = [f"__key{i}" for i in range(len(keys))]
    totals = totals.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        F.col(slot).alias("__slot"),
        F.coalesce(F.sum(amount).over(before), F.lit(0)).alias(base),
    )
    within = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    same = F.col(slot) == F.col("__slot")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    kept = [c for c in df.columns if c != out]
    return rows.join(totals, same).select(*kept, (F.col(out) + F.col(base)).cast("long").alias(out))


def row_key(df: DataFrame) -> Column:
    """128 bits of all columns: rows share a key if they are equal."""
    cols = [
        F.to_json(F.struct(df[f.name])) if "map<" in f.dataType.simpleString() else df[f.name] for f in df.schema
    ]
    # a null leaves the hash as it was, so nulls are told from their place
    cols.append(F.array(*[c.isNull() for c in cols]))
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def unique_rows(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its row key, fully equal rows once."""
    return df.withColumn(key, row_key(df)).dropDuplicates([key])


# --- bounded membership filters -------------------------------------------------------

#: Bits of one piece of a filter, as ``bitmap_construct_agg`` makes them.
_PIECE_BITS = 32768


def membership_bits(hashes: DataFrame, column: str, bits: int) -> bytes:
    """A bit array with bit ``hash mod bits`` set for every value; ``bits`` a power of 2.

    Its size is fixed by ``bits``, whatever the number of rows, so it may be collected
    and broadcast.  It has false positives and no false negatives: users of it drop
    only what is certainly absent.
    """
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    pieces = (
        hashes.select(place.alias("place"))
        .groupBy(F.floor(F.col("place") / _PIECE_BITS).cast("long").alias("piece"))
        .agg(F.expr(f"bitmap_construct_agg(place % {_PIECE_BITS})").alias("bitmap"))
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in pieces.collect():
        at = row["piece"] * _PIECE_BITS // 8
        out[at : at + len(row["bitmap"])] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return out.tobytes()


def maybe_members(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the filter."""
    known = np.frombuffer(bitmap, dtype=np.uint8)
    place = hashes & np.uint64(8 * len(known) - 1)
    return (known[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


# --- Python on executors -------------------------------------------------------------------

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's sources to the executors, once for each application.

    Functions of its modules run in tasks by name, so workers must be able to import
    them also where only the driver has the package.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str
) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the tasks."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)
