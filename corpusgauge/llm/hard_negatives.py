"""Hard negatives of anchors, by an inverted multi-index with certified stopping.

Vectors are cut into two halves; each half has its own codebook, and a pair of codewords
is a cell.  A cell keeps the greatest distance of its rows from either codeword, so
``q1.c1 + |q1| r1 + q2.c2 + |q2| r2`` bounds the inner product of any of its rows.  For a
query a heap merges the two falling lists of half scores and so visits the cells by
falling bound (multi-sequence search).  A search has two rounds:

1. *Probe.*  The first cells, of ``PROBE_ROWS`` rows in all, are scored.  They give every
   score window of the query its k-th best row so far.
2. *Certify.*  The same heap goes on until its bound falls below the k-th best of every
   window; cells whose bounds miss all windows are passed over.  What was never visited
   cannot be in a result, so results are exact whatever the codebooks are.

Cells in turn are packed into shelves of about ``SHELF_ROWS`` rows; a cell that is larger,
such as one of very many equal vectors, is dealt over several.  A task holds one shelf
and streams the queries that asked for cells of it.  The codebooks are fitted on at most
``SAMPLE_ROWS`` rows; all rows are indexed.

Rows with a null id, label or vector, or a null or non-finite component take no part.  Of
vectors of unequal length the shorter count as filled up with zeros.  Rows of one id are
rows of their own and never each other's positive or negative; equal anchors count once.
Ties go by the smaller id.  A score beyond a long is held at its limit.  An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.frames import map_batches
from corpusgauge.session import stored

SCALE = 256
#: Codewords of a half; a multi-index has at most their square of cells.
CODEWORDS = 32
#: Rows the codebooks are fitted on at most.
SAMPLE_ROWS = 8_192
SHELF_ROWS, PROBE_ROWS = 4_096, 2_048
#: Queries scored against a shelf at once.
QUERY_BLOCK = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_SEED = 41


# --- rows and index ----------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """Codebooks and, for each cell with rows, its codewords, radii and shelves."""

    books: tuple[np.ndarray, np.ndarray]
    words: np.ndarray
    radii: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    shelves: np.ndarray

    def __post_init__(self) -> None:
        place = np.full((len(self.books[0]), len(self.books[1])), -1)
        place[self.words[:, 0], self.words[:, 1]] = np.arange(len(self.words))
        object.__setattr__(self, "place", place)
        # the greatest radius of a codeword over its cells; -1 where it has none
        reach = [np.full(len(book), -1.0) for book in self.books]
        for half in (0, 1):
            np.maximum.at(reach[half], self.words[:, half], self.radii[:, half])
        object.__setattr__(self, "reach", reach)


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part; ``x`` are scaled whole numbers."""
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(~odd)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda v: _floor(v.cast("double") * SCALE))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("x"))


def _floor(v: Column) -> Column:
    # floor() gives a long, which saturates; a double this large has no fraction
    return F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = np.asarray(column.flatten(), dtype=np.float64)
    return out


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def codebook(points: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """At most ``size`` centres of ``points``, by Lloyd's rounds from a seeded start."""
    points = np.unique(points, axis=0)
    centres = points[np.sort(np.random.default_rng(_SEED).permutation(len(points))[:size])]
    for _ in range(rounds):
        near = nearest(points, centres)[0]
        held = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and its distance (rounded up a little)."""
    near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(axis=1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(axis=1)) * (1 + 1e-12)


def build(rows: DataFrame, dim: int) -> tuple[Index, DataFrame]:
    """The index of ``usable`` rows, and ``shelf, cell, vec_id, label, x`` of all of them."""
    sample = rows.orderBy(F.xxhash64(F.lit(_SEED), "vec_id"), "vec_id", "label").limit(SAMPLE_ROWS).select("x").toArrow()
    points, half = _matrix(sample.column("x"), dim), dim // 2
    books = (codebook(points[:, :half], CODEWORDS), codebook(points[:, half:], CODEWORDS))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            (a, r), (b, s) = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id"),
                    "label": batch.column("label"),
                    "x": pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary()),
                    "a": pa.array(a, pa.int32()),
                    "b": pa.array(b, pa.int32()),
                    "r": pa.array(r),
                    "s": pa.array(s),
                    # deals the rows of a large cell over its shelves
                    "turn": pa.array(np.arange(turn, turn + len(x))),
                }
            )
            turn += len(x)

    schema = "vec_id BIGINT, label BIGINT, x BINARY, a INT, b INT, r DOUBLE, s DOUBLE, turn BIGINT"
    placed = stored(map_batches(rows, assign, schema), "cells")
    # one row for each cell, at most CODEWORDS squared
    cells = placed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("r"), F.max("s")).orderBy("a", "b").collect()
    n = np.array([c["n"] for c in cells])
    shelves = -(-n // SHELF_ROWS)
    # small cells share a shelf with their neighbours, large ones have shelves of their own
    first, at, held = [], 0, 0
    for rows_held, wide in zip(n.tolist(), shelves.tolist(), strict=True):
        if held and held + rows_held > SHELF_ROWS:
            at, held = at + 1, 0
        first.append(at)
        at, held = (at + wide, 0) if wide > 1 else (at, held + rows_held)
    index = Index(books, np.array([c[:2] for c in cells]), np.array([c[3:] for c in cells]), n, np.array(first), shelves)

    def shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, turn = (batch.column(c).to_numpy() for c in ("a", "b", "turn"))
            cell = index.place[a, b]
            shelf = index.first[cell] + turn % index.shelves[cell]
            yield pa.record_batch(
                [pa.array(shelf, pa.int32()), pa.array(cell, pa.int32()), *[batch.column(c) for c in ("vec_id", "label", "x")]],
                names=["shelf", "cell", "vec_id", "label", "x"],
            )

    return index, map_batches(placed, shelve, "shelf INT, cell INT, vec_id BIGINT, label BIGINT, x BINARY")


# --- cells of a query ----------------------------------------------------------------------


def by_falling_bound(index: Index, query: np.ndarray) -> Iterator[tuple[float, float, float, int]]:
    """``(bound, upper, lower, cell)`` of all cells, by falling ``bound``.

    ``bound`` sums the half-score bounds of the codewords, ``upper`` and ``lower`` hold
    for the rows of this cell.  The heap has one entry for each codeword in play.
    """
    half = index.books[0].shape[1]
    parts = (query[:half], query[half:])
    scores = [book @ part for book, part in zip(index.books, parts, strict=True)]
    norms = [float(np.sqrt(part @ part)) for part in parts]
    # floating sums may be off by a little
    slack = 1e-9 * sum(norms) * (sum(float(np.abs(book).max(initial=0)) * book.shape[1] for book in index.books) + float(index.radii.max(initial=0))) + 1e-6
    tops = [np.where(reach >= 0, s + n * reach, -np.inf) for s, n, reach in zip(scores, norms, index.reach, strict=True)]
    left, right = (np.argsort(-top, kind="stable") for top in tops)
    left, right = left[np.isfinite(tops[0][left])].tolist(), right[np.isfinite(tops[1][right])].tolist()
    one, two = tops[0].tolist(), tops[1].tolist()
    heap = [(-(one[left[0]] + two[right[0]]), 0, 0)] if left and right else []
    while heap:
        negative, i, j = heapq.heappop(heap)
        if j + 1 < len(right):
            heapq.heappush(heap, (-(one[left[i]] + two[right[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(left):
            heapq.heappush(heap, (-(one[left[i + 1]] + two[right[0]]), i + 1, 0))
        cell = int(index.place[left[i], right[j]])
        if cell >= 0:
            middle = float(scores[0][left[i]] + scores[1][right[j]])
            span = norms[0] * float(index.radii[cell, 0]) + norms[1] * float(index.radii[cell, 1])
            yield slack - negative, middle + span + slack, middle - span - slack, cell


def cells_to_visit(
    index: Index, query: np.ndarray, lows: list[int], highs: list[int], tops: list[int] | None
) -> list[int]:
    """The cells of the probe, or with ``tops`` (k-th best scores so far) of the rest."""
    out, seen = [], 0
    for bound, upper, lower, cell in by_falling_bound(index, query):
        if bound < min(lows if tops is None or seen < PROBE_ROWS else tops):
            break
        if seen < PROBE_ROWS:
            if any(upper >= lo and lower <= hi for lo, hi in zip(lows, highs, strict=True)):
                seen += int(index.rows[cell])
                if tops is None:
                    out.append(cell)
        elif tops is None:
            break
        elif any(upper >= top and lower <= hi for top, hi in zip(tops, highs, strict=True)):
            out.append(cell)
    return out


# --- search ---------------------------------------------------------------------------------

_ASKED = "q BIGINT, anchor_id BIGINT, label BIGINT, x BINARY, lows ARRAY<BIGINT>, highs ARRAY<BIGINT>"


def _requests(queries: DataFrame, index: Index, dim: int, certify: bool) -> DataFrame:
    """A row for each query and shelf it visits, with the cells wanted there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _unpacked(batch.column("x"), dim)
            lows, highs = batch.column("lows").to_pylist(), batch.column("highs").to_pylist()
            tops = batch.column("tops").to_pylist() if certify else [None] * len(lows)
            for i, vector in enumerate(vectors):
                wanted: dict[int, list[int]] = {}
                for cell in cells_to_visit(index, vector, lows[i], highs[i], tops[i]):
                    for shelf in range(index.first[cell], index.first[cell] + index.shelves[cell]):
                        wanted.setdefault(int(shelf), []).append(cell)
                if wanted:
                    columns = {c: batch.column(c).take(pa.array([i] * len(wanted))) for c in ("q", "anchor_id", "label", "x")}
                    columns["lows"] = pa.array([tops[i] or lows[i]] * len(wanted), pa.list_(pa.int64()))
                    columns["highs"] = pa.array([highs[i]] * len(wanted), pa.list_(pa.int64()))
                    columns["shelf"] = pa.array(list(wanted), pa.int32())
                    columns["cells"] = pa.array(list(wanted.values()), pa.list_(pa.int32()))
                    yield pa.record_batch(columns)

    return map_batches(queries, ask, f"{_ASKED}, shelf INT, cells ARRAY<INT>")


def _products(x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    most = np.abs(x).max(initial=0) * np.abs(vectors).max(initial=0) * x.shape[1]
    if most < 1 << 53:
        return (vectors @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in x]
    found = [[sum(a * int(b) for a, b in zip(row, v, strict=True)) for row in whole] for v in vectors]
    return np.array([[min(max(p, LEAST), MOST) for p in line] for line in found], dtype=np.int64).reshape(len(vectors), len(x))


@dataclass
class _Shelf:
    ids: np.ndarray
    labels: np.ndarray
    cells: np.ndarray
    x: np.ndarray

    def best(self, asked: list[dict], dim: int, k: int, same: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """``(q, anchor_id, window, vec_id, score)`` of the first ``k`` rows of each window."""
        scores = _products(self.x, np.stack([np.frombuffer(a["x"], "<f8") for a in asked]))
        for a, line in zip(asked, scores, strict=True):
            fit = (self.labels == a["label"]) == same
            fit &= (self.ids != a["anchor_id"]) & np.isin(self.cells, a["cells"])
            at = np.flatnonzero(fit)
            line = line[at]
            for w, (lo, hi) in enumerate(zip(a["lows"], a["highs"], strict=True)):
                inside = np.flatnonzero((line >= lo) & (line <= hi))
                if len(inside) > k:
                    # rows lie by id, so a stable order settles ties
                    least = -np.partition(-line[inside], k - 1)[k - 1]
                    inside = inside[line[inside] >= least]
                    inside = inside[np.argsort(-line[inside], kind="stable")[:k]]
                for i in inside:
                    yield a["q"], a["anchor_id"], w, int(self.ids[at[i]]), int(line[i])


def _scored(rows: DataFrame, requests: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows of each window among the cells asked for, shelf by shelf."""
    empty = {"q": "BIGINT", "anchor_id": "BIGINT", "lows": "ARRAY<BIGINT>", "highs": "ARRAY<BIGINT>", "cells": "ARRAY<INT>"}
    held = rows.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()}).withColumn("kind", F.lit(0))
    asked = requests.withColumns({"cell": F.lit(None).cast("int"), "vec_id": F.lit(None).cast("long"), "kind": F.lit(1)})
    both = held.unionByName(asked).repartition("shelf").sortWithinPartitions("shelf", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shelf = None, [], None
        for batch in batches:
            shelves, kinds = batch.column("shelf").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(shelves) != 0) | (np.diff(kinds) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(shelves)], strict=True):
                if begin == end:
                    continue
                if shelves[begin] != at:
                    at, parts, shelf = shelves[begin], [], None
                run = batch.slice(begin, end - begin)
                if kinds[begin] == 0:
                    parts.append(run.select(["vec_id", "label", "cell", "x"]))
                    continue
                if shelf is None:
                    table = pa.Table.from_batches(parts).sort_by("vec_id") if parts else None
                    if table is None:
                        continue
                    ids, labels, cells = (table.column(c).to_numpy() for c in ("vec_id", "label", "cell"))
                    shelf, parts = _Shelf(ids, labels, cells, _unpacked(table.column("x"), dim)), []
                for block in range(0, run.num_rows, QUERY_BLOCK):
                    found = list(shelf.best(run.slice(block, QUERY_BLOCK).to_pylist(), dim, k, same))
                    columns = zip(*found, strict=True) if found else [[]] * 5
                    names = ("q", "anchor_id", "w", "vec_id", "score")
                    yield pa.record_batch({c: pa.array(list(v), pa.int64()) for c, v in zip(names, columns, strict=True)})

    return map_batches(both, answer, "q BIGINT, anchor_id BIGINT, w BIGINT, vec_id BIGINT, score BIGINT")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(rows: DataFrame, index: Index, queries: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """``q, anchor_id, w, vec_id, score, rank``: the first ``k`` rows of each query's windows.

    ``queries`` has ``q, anchor_id, label, x`` and the windows as arrays ``lows`` and
    ``highs``; rows of the query's label are searched, or those of other labels.
    """
    probe = stored(_first(_scored(rows, _requests(queries, index, dim, False), dim, k, same), k).drop("rank"), "probe")
    # of a window with fewer than k rows yet, all of it is still open
    met = probe.groupBy("q", "anchor_id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    met = met.filter(F.col("n") >= k).groupBy(F.col("q").alias("q_"), F.col("anchor_id").alias("anchor_"))
    met = met.agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("best"))
    known = queries.join(met, (F.col("q") == F.col("q_")) & (F.col("anchor_id") == F.col("anchor_")), "left")
    tops = F.transform("lows", lambda lo, w: F.greatest(lo, F.coalesce(F.try_element_at("best", w.cast("long")), lo)))
    rest = _requests(known.withColumn("tops", tops).drop("q_", "anchor_", "best"), index, dim, True)
    return _first(probe.unionByName(_scored(rows, rest, dim, k, same)), k)


# --- mining ------------------------------------------------------------------------------------

_MINED = "anchor_id BIGINT, positive_id BIGINT, rank INT, negative_id BIGINT, positive_score BIGINT, negative_score BIGINT"


def hard_negatives(
    embeddings: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``.  For each of the first
    ``positives`` rows of an anchor's label, the first ``negatives`` rows of other labels
    that score from ``least_percent`` to ``most_percent`` of the positive's score.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], _MINED)
    index, shelved = build(rows, dim)
    anchors = shelved.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "x").distinct()
    anchors = stored(anchors.withColumn("q", F.xxhash64("anchor_id", "label", "x")), "anchors")
    open_ = anchors.select(
        "q", "anchor_id", "label", "x", F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs")
    )
    near = search(shelved, index, open_, dim, positives, True)
    near = stored(near.select("q", "anchor_id", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most ``positives`` entries for each anchor
    windows = near.groupBy(F.col("q").alias("q_"), F.col("anchor_id").alias("anchor_"))
    windows = windows.agg(F.array_sort(F.collect_list(F.struct("w", "positive_score"))).alias("p"))
    edges = F.transform(
        "p",
        lambda p: F.struct(
            F.ceil(p["positive_score"].cast("decimal(25,0)") * least_percent / 100).cast("long").alias("lo"),
            F.floor(p["positive_score"].cast("decimal(25,0)") * most_percent / 100).cast("long").alias("hi"),
        ),
    )
    asked = anchors.join(windows.withColumn("e", edges), (F.col("q") == F.col("q_")) & (F.col("anchor_id") == F.col("anchor_")))
    asked = asked.select("q", "anchor_id", "label", "x", F.col("e.lo").alias("lows"), F.col("e.hi").alias("highs"))
    hard = search(shelved, index, asked, dim, negatives, False)
    hard = hard.select(F.col("q").alias("q_"), F.col("w").alias("w_"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    met = near.join(hard, (F.col("q") == F.col("q_")) & (F.col("w") == F.col("w_")))
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
