"""Shards that all hold the same mixture of sources.

Proportional stratified interleaving: the rows of each source are ranked in a seeded
shuffle, a row's place is its fractional rank ``(2 * rank + 1) / (2 * source rows)``,
and the sequence of all rows by place is cut into runs of equal row counts (law
``rows``).  Any run then holds of each source its share, give or take a row or two.

A null text counts as empty, a null source is a source of its own, repeated rows and
repeated or null ids are rows like any other, an empty table gives no rows.  Other
columns are not read by ``shard_plan`` and are kept by ``sharded``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.frames import fresh, row_key, unique_rows, with_running_sum

#: Rows of a source, or of the sequence, that one window may hold on average.
ROWS_A_BUCKET = 200_000
#: What a row costs besides its text.
OVERHEAD_BYTES = 8


def text_size() -> Column:
    return (F.coalesce(F.octet_length(F.col("text")), F.lit(0)) + OVERHEAD_BYTES).cast("long")


def interleaved(rows: DataFrame, seed: int = 17, tie: tuple[str, ...] = ()) -> DataFrame:
    """Add ``place``, the gapless position in the interleaved sequence.

    ``rows`` has ``source, doc_id`` and the columns of ``tie``, which order rows of one
    id; rows equal in all of these may change places.
    """
    n_rows = rows.count()
    buckets = max(1, -(-n_rows // ROWS_A_BUCKET))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), *[F.col(c) for c in tie])
    rows = rows.withColumn("__key", key)
    # hash buckets in hash order: a monotone cut of the 64-bit range
    slot = F.floor((F.col("__key").cast("double") / 2.0**64 + 0.5) * buckets).cast("long")
    order = [F.col("__key"), F.col("doc_id"), *[F.col(c) for c in tie]]
    ranked = with_running_sum(rows, F.lit(1), "__rank", ["source"], slot, order)
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("source", "__s")
    ranked = ranked.join(sizes, ranked["source"].eqNullSafe(sizes["__s"])).drop("__s")
    ranked = ranked.withColumn("__part", (2 * F.col("__rank") + 1) / (2 * F.col("__n")))
    slot = F.floor(F.col("__part") * buckets).cast("long")
    order = [F.col("__part"), F.col("source"), F.col("__key"), F.col("doc_id"), *[F.col(c) for c in tie]]
    placed = with_running_sum(ranked, F.lit(1), "place", [], slot, order)
    return placed.drop("__key", "__rank", "__n", "__part")


def cut(placed: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Add ``shard`` and ``slot``: counts of any two shards differ by one at most."""
    # whole numbers throughout; the first place of shard s is ceil(s * n_rows / n_shards)
    shard = F.expr(f"CAST((place * {n_shards}L) DIV {max(1, n_rows)}L AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {n_rows}L + {n_shards - 1}L) DIV {n_shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first)


def shard_plan(docs: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` of every row of ``docs``.

    Texts stay in the scan: only their size and checksum are shuffled.
    """
    rows = docs.select(
        "doc_id",
        "source",
        text_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = interleaved(rows, seed, ("text_crc32", "size"))
    return cut(placed, docs.count(), n_shards).drop("place")


def sharded(docs: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (numbered anew if it has such columns).

    The plan is made of narrow rows; the texts are shuffled once, to meet it.
    """
    docs = docs.drop("shard", "slot")
    key = fresh(docs, "row_key")
    rows = docs.select("source", "doc_id", row_key(docs).alias("wanted"))
    plan = cut(interleaved(rows, seed, ("wanted",)), docs.count(), n_shards)
    return (
        unique_rows(docs, key)
        .join(plan.select("wanted", "shard", "slot"), F.col(key) == F.col("wanted"))
        .select(*docs.columns, "shard", "slot")
    )
