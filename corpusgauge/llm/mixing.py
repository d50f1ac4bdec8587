"""Mix sources to target weights by a low-discrepancy schedule.

The mixture is a sequence of slots of equally many tokens.  Slot ``i`` is the van der
Corput point of ``i`` (its bits reversed); the source whose share of the cumulated targets
holds the point supplies the slot.  The slots of a source are ranked, and rank ``r`` takes
the source's r-th token block.  The blocks of a source are cut from its documents in a
seeded shuffle, laid end to end and repeated as often as the target asks for; the last
block ends where the target is met.  Every stretch of the schedule so holds each source
close to its weight, and each source's total is its target to the token.

Points and shares are whole numbers: with ``2**k`` points, no fewer than slots are needed,
an interval holds exactly as many points as it is long, so every block has its slot.
Only what has a slot is in the mixture.

A null text has size 0 and is never taken.  A null source is a source of its own, the
last.  A source without tokens has target 0.  Equal rows are told apart only by number:
which of them is taken more often is not defined, their totals are.  A very long text is
cut into as many blocks as it fills.  Other columns are kept by ``mixed``, whatever their
names, and not read elsewhere.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm.frames import WORD, fresh, map_batches, row_key, unique_rows, with_running_sum
from corpusgauge.session import stored

#: How often a source may be gone through.
MAX_REPEATS = 3
#: Tokens of a slot.
SLOT_TOKENS = 256
#: Slots, or documents, that one window may hold on average.
ROWS_A_BUCKET = 200_000


@dataclass(frozen=True)
class Target:
    source: str | None
    size: int
    weight: float
    tokens: float


def weights_in_order(n: int, cycle: Sequence[float] = (1, 2, 3)) -> list[float]:
    return [cycle[i % len(cycle)] for i in range(n)]


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], budget: float) -> list[Target]:
    """Share ``budget`` by weight; what is above ``MAX_REPEATS`` sizes is shared again."""
    caps = [float(MAX_REPEATS * size) for _, size in sizes]
    given = [0.0] * len(sizes)
    free = {i for i, cap in enumerate(caps) if cap > 0}
    left = min(float(budget), sum(caps))
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / total >= caps[i]}
        for i in full or free:
            given[i] = caps[i] if full else left * weights[i] / total
        if not full:
            break
        left = max(0.0, left - sum(caps[i] for i in full))
        free -= full
    return [Target(s, n, w, t) for (s, n), w, t in zip(sizes, weights, given, strict=True)]


def sized(docs: DataFrame, *tie: str) -> DataFrame:
    """``doc_id, source, size`` and the columns of ``tie``."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), *tie)


def source_targets(rows: DataFrame, cycle: Sequence[float] = (1, 2, 3)) -> list[Target]:
    """Targets of all sources by code point, null last; their total is that of all sizes.

    One row for each source comes to the driver: a mixture names its sources.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    sizes = sorted(((r["source"], r["size"]) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    return targets(sizes, weights_in_order(len(sizes), cycle), sum(n for _, n in sizes))


def _reversed(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits in reverse: van der Corput points in units of ``2**-bits``."""
    out, rest = np.zeros_like(values), values.copy()
    for _ in range(bits):
        out, rest = (out << 1) | (rest & 1), rest >> 1
    return out


def _points_below(slot: np.ndarray, bound: np.ndarray, bits: int) -> np.ndarray:
    """How many of the points of slots ``0 .. slot - 1`` are less than ``bound``.

    The earlier slots are, for each bit that ``slot`` has, those that agree above it, lack
    it and are free below it; their points are evenly spaced.
    """
    total = np.zeros_like(slot)
    for b in range(bits):
        offset = _reversed(slot >> (b + 1) << (b + 1), bits)
        step = 1 << (bits - b)
        total += ((slot >> b) & 1) * np.clip((bound - offset + step - 1) // step, 0, 1 << b)
    return total


def blocks_needed(target: Target, slot_tokens: int = SLOT_TOKENS) -> int:
    return -(-round(target.tokens) // slot_tokens)


def schedule(spark: SparkSession, plan: Sequence[Target], slot_tokens: int = SLOT_TOKENS) -> DataFrame:
    """``slot, src, rank``: which source supplies each slot, and its how manieth it is.

    ``src`` is the index in ``plan``.  Slots past a source's target are left out; each of
    its blocks has exactly one.  Ranks are counted from the bits of the slot, so nothing is
    shuffled; tasks get eight bytes for each source.
    """
    needed = np.array([blocks_needed(t, slot_tokens) for t in plan], dtype=np.int64)
    n_blocks = int(needed.sum())
    bits = max(n_blocks - 1, 0).bit_length()
    # cumulated shares of the points, rounded up: no share is less than its blocks
    ends = [0]
    for k in np.cumsum(needed).tolist():
        ends.append(-(-(k << bits) // max(n_blocks, 1)))
    shared = spark.sparkContext.broadcast((np.array(ends, dtype=np.int64), needed))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, wanted = shared.value
        for batch in batches:
            slot = batch.column("id").to_numpy()
            src = np.searchsorted(bounds, _reversed(slot, bits), side="right") - 1
            rank = _points_below(slot, bounds[src + 1], bits) - _points_below(slot, bounds[src], bits)
            keep = rank < wanted[src]
            yield pa.record_batch(
                [pa.array(slot[keep]), pa.array(src[keep], pa.int32()), pa.array(rank[keep])], names=["slot", "src", "rank"]
            )

    return map_batches(spark.range(1 << bits if n_blocks else 0), assign, "slot BIGINT, src INT, rank BIGINT")


def placements(
    rows: DataFrame, plan: Sequence[Target], seed: int = 29, tie: Sequence[str] = (), slot_tokens: int = SLOT_TOKENS
) -> DataFrame:
    """The mixture: which tokens of which document each slot takes.

    ``slot, source, doc_id, *tie, size, source_size, target, repeat, token_from,
    token_to``; the tokens are those of the document, ``repeat`` counts the times the
    source was gone through before.
    """
    spark = rows.sparkSession
    names = spark.createDataFrame(
        [(i, t.source, t.size, t.tokens, round(t.tokens)) for i, t in enumerate(plan)],
        "src INT, s STRING, source_size BIGINT, target DOUBLE, quota BIGINT",
    )
    n_rows = rows.count()
    buckets = max(1, -(-n_rows // ROWS_A_BUCKET))
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", *tie))
    bucket = F.floor((F.col("__h").cast("double") / 2.0**64 + 0.5) * buckets).cast("long")
    order = [F.col("__h"), F.col("doc_id"), *[F.col(c) for c in tie], F.col("size")]
    laid = with_running_sum(rows, F.col("size"), "__at", ["source"], bucket, order).drop("__h")
    # one row for each source; Spark broadcasts them below its own threshold
    laid = laid.join(names, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    laid = laid.filter((F.col("size") > 0) & (F.col("quota") > 0))
    laid = laid.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    laid = laid.withColumn("__from", F.col("__at") + F.col("repeat") * F.col("source_size"))
    laid = laid.withColumn("__to", F.least(F.col("__from") + F.col("size"), F.col("quota")))
    laid = laid.filter(F.col("__from") < F.col("__to"))
    first, final = F.floor(F.col("__from") / slot_tokens), F.floor((F.col("__to") - 1) / slot_tokens)
    pieces = laid.withColumn("rank", F.explode(F.sequence(first.cast("long"), final.cast("long"))))
    slots = schedule(spark, plan, slot_tokens).withColumnRenamed("src", "__src").withColumnRenamed("rank", "__rank")
    met = pieces.join(slots, (F.col("src") == F.col("__src")) & (F.col("rank") == F.col("__rank")))
    begin = F.greatest(F.col("__from"), F.col("rank") * slot_tokens) - F.col("__from")
    end = F.least(F.col("__to"), (F.col("rank") + 1) * slot_tokens) - F.col("__from")
    return met.select(
        "slot",
        "source",
        "doc_id",
        *tie,
        "size",
        "source_size",
        "target",
        "repeat",
        begin.cast("long").alias("token_from"),
        end.cast("long").alias("token_to"),
    )


def taken_by_document(docs: DataFrame, cycle: Sequence[float] = (1, 2, 3), seed: int = 29) -> DataFrame:
    """One row for each row of ``docs``: its size, its source's size and target, words taken.

    ``first_slot`` is the first slot that takes words of it, null where none does.  Equal
    rows share what they take evenly, the earlier of them the odd words.
    """
    keyed = docs.select("doc_id", "source", "text").withColumn("__crc", F.crc32(F.col("text").cast("binary")))
    rows = stored(sized(keyed, "__crc"), "mixing")
    plan = source_targets(rows, cycle)
    met = placements(rows, plan, seed, ("__crc",))
    same = ["doc_id", "source", "__crc", "size"]
    got = met.groupBy(*same).agg(F.sum(F.col("token_to") - F.col("token_from")).alias("got"), F.min("slot").alias("first_slot"))
    got = got.select(*[F.col(c).alias(f"_{c}") for c in same], "got", "first_slot")
    counts = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    match = F.lit(True)
    for c in same:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    counted = counts.join(got, match, "left").withColumn("got", F.coalesce("got", F.lit(0)))
    each = counted.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    share = F.expr("got DIV n + CASE WHEN i < got % n THEN 1 ELSE 0 END")
    names = docs.sparkSession.createDataFrame(
        [(t.source, t.size, t.tokens) for t in plan], "s STRING, source_size BIGINT, target DOUBLE"
    )
    return each.join(names, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", share.cast("long").alias("taken"), "first_slot"
    )


def mixed(docs: DataFrame, cycle: Sequence[float] = (1, 2, 3), seed: int = 29) -> DataFrame:
    """``docs`` as the mixture takes them: a row as often as its first word is taken.

    Documents are whole, so a source comes within one document of its target.  Rows of
    no words are never taken.
    """
    key = fresh(docs, "row_key")
    rows = stored(sized(docs.withColumn("__key", row_key(docs)), "__key"), "mixing")
    met = placements(rows, source_targets(rows, cycle), seed, ("__key",))
    taken = met.filter("token_from = 0").select(F.col("__key").alias("wanted"))
    return unique_rows(docs, key).join(taken, F.col(key) == F.col("wanted")).select(*docs.columns)
