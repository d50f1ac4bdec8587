"""Hard negatives and whitening, against plain readings of their contracts."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import SparkSession

from corpusgauge.llm import hard_negatives as H
from corpusgauge.llm import whitening as W


@pytest.fixture(scope="module")
def make_vectors(spark: SparkSession):
    """``embeddings`` rows with columns more whose names clash with inner ones."""

    def build(rows: list[tuple], kind: str = "FLOAT"):
        schema = f"vec_id BIGINT, embedding ARRAY<{kind}>, label INT, shelf STRING, n STRING, x INT"
        return spark.createDataFrame([(i, v, label, "s", "n", 1) for i, v, label in rows], schema).repartition(3)

    return build


def plain(rows: list[tuple]) -> list[tuple]:
    """Mined rows of rows without repeats, by scoring everything."""
    good = [(i, v, y) for i, v, y in rows if None not in (i, v, y) and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v, _ in good), default=0)
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)), (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in good]
    out = []
    for i, v, y in good:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in good if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][:5]:
            hard = [(-n, k) for n, k, z in scored if z != y and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(i, j, r, k, -p, n) for r, (n, k) in enumerate(hard, 1)]
    return sorted(out)


def clustered(n: int, dim: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    found = centres[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, dim))
    return [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 10))) for i, v in enumerate(found)]


ODD = [(900, None, 1), (901, [], 2), (902, [1.0, None], 3), (903, [math.nan, 1.0], 3), (904, [math.inf], 3), (None, [1.0], 1), (905, [1.0] * 6, None)]


@pytest.mark.parametrize("probe", [8, 2048])
def test_hard_negatives_equal_brute_force(make_vectors, monkeypatch, probe):
    # small probes and shelves: certification has to find the rest
    monkeypatch.setattr(H, "PROBE_ROWS", probe)
    monkeypatch.setattr(H, "SHELF_ROWS", 64)
    monkeypatch.setattr(H, "CODEWORDS", 5)
    rows = clustered(600, 6, 3) + ODD
    rows = [(i, v[:4] if i == 300 else v, y) for i, v, y in rows]  # a short vector
    assert sorted(map(tuple, H.hard_negatives(make_vectors(rows)).collect())) == plain(rows)


def test_hard_negatives_with_many_equal_vectors(make_vectors, monkeypatch):
    monkeypatch.setattr(H, "SHELF_ROWS", 32)
    rows = clustered(210, 5, 4)
    rows += [(1000 + i, rows[0][1], i % 4) for i in range(200)]
    got = sorted(map(tuple, H.hard_negatives(make_vectors(rows)).collect()))
    assert got == plain(rows) and any(r[3] >= 1000 for r in got)


def test_probe_leaves_cells_unvisited():
    """On separated clusters the bounds stop the heap early; what is left out scores lower."""
    rng = np.random.default_rng(1)
    books = (np.eye(4) * 100, np.eye(4) * 100)
    cells = np.array([(a, b) for a in range(4) for b in range(4)])
    index = H.Index(books, cells, np.full((16, 2), 5.0), np.full(16, 1), np.zeros(16, dtype=int), np.ones(16, dtype=int))
    query = np.concatenate([books[0][1], books[1][2]]) + rng.normal(size=8)
    order = list(H.by_falling_bound(index, query))
    assert [b for b, *_ in order] == sorted((b for b, *_ in order), reverse=True) and len(order) == 16
    assert index.words[order[0][3]].tolist() == [1, 2]
    assert all(lower <= upper <= bound + 1e-6 for bound, upper, lower, _ in order)
    rest = H.cells_to_visit(index, query, [0], [10**9], [15_000])
    assert rest == [] or len(rest) < 15


def test_hard_negatives_repeats_empty_and_large(make_vectors):
    assert H.hard_negatives(make_vectors([])).collect() == []
    assert H.hard_negatives(make_vectors(ODD)).collect() == []
    rows = clustered(120, 4, 5)
    once = sorted(map(tuple, H.hard_negatives(make_vectors(rows)).collect()))
    # an anchor that stands twice counts once
    again = sorted(map(tuple, H.hard_negatives(make_vectors([*rows, rows[100]])).collect()))
    assert [r for r in again if r[0] == 100] == [r for r in once if r[0] == 100]
    # products beyond 2**53 are exact
    big = [(100, [2.0**22 + 1, 3.0], 1), (101, [2.0**22 + 3, 5.0], 1), (102, [2.0**21 + 1, 7.0], 2), (103, [2.0**20, -1.0], 2)]
    got = sorted(map(tuple, H.hard_negatives(make_vectors(big, "DOUBLE")).collect()))
    assert got == plain(big) and len(got) == 1


# --- whitening --------------------------------------------------------------------------------


def test_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(8)
    half = rng.integers(-9, 9, size=(6, 5))
    m = (half.T @ half).tolist()
    c = W.characteristic_polynomial(spark, m)
    values = np.sort(np.linalg.eigvalsh(np.array(m, dtype=float)))[::-1]
    assert np.allclose(np.array(c, dtype=float)[::-1], np.poly(np.array(m, dtype=float)), rtol=1e-9)
    got = W.greatest_roots(c, 5, sum(m[i][i] for i in range(5)))
    assert np.allclose([r / 2**W.ROOT_BITS for r in got], values, rtol=1e-12)
    # a multiple root: (x - 3)^2 (x - 1)
    assert W.roots_above([-9, 15, -7, 1], 2) == 2
    assert [round(r / 2**W.ROOT_BITS, 9) for r in W.greatest_roots([-9, 15, -7, 1], 3, 7)] == [3, 3, 1]
    assert all(W.is_prime(p) for p in W.primes_below(1 << 31, 100)) and not W.is_prime(2147483646)
    assert [p for p in range(200) if W.is_prime(p)] == [p for p in range(2, 200) if all(p % q for q in range(2, p))]


def check_whitening(rows: list[tuple], got: list, k: int) -> None:
    good = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in good)
    x = np.array([[math.floor(1024 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v in good]) + 100_000
    n = len(x)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(got) == n * k and {r.n for r in got} == {n}
    deviation = {i: int(((n * v - x.sum(axis=0)) ** 2).sum()) for (i, _), v in zip(good, x, strict=True)}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    wanted = centred @ vectors / np.sqrt(values)
    for c in range(k):
        mine = {r.vec_id: r for r in got if r.component == c + 1}
        w = np.array([mine[i].whitened for i, _ in good])
        sign = np.sign(w @ wanted[:, c])
        assert np.allclose(sign * w, wanted[:, c], atol=1e-8)
        assert abs(next(iter(mine.values())).explained / (values[c] / np.trace(centred.T @ centred / n)) - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_equals_a_plain_eigensolver(make_vectors):
    rows = clustered(300, 10, 6) + [r for r in ODD if r[1] != []]
    rows = [r for r in rows if r[0] is not None and r[0] != 905]
    check_whitening(rows, W.whitened(make_vectors(rows)).collect(), 8)
    few = clustered(40, 3, 7)
    few.append((77, few[0][1][:2], None))  # a short vector, without a label
    check_whitening(few, W.whitened(make_vectors(few)).collect(), 3)


def test_whitening_of_equal_nearly_equal_and_degenerate_spread(make_vectors):
    # a multiple eigenvalue: any orthonormal pair will do, the covariance is still the identity
    square = [(i, [a / 8, b / 8], 0) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    got = W.whitened(make_vectors(square)).collect()
    assert len(got) == 8 and got[0].identity_error < 1e-9 and all(abs(r.explained - 0.5) < 1e-12 for r in got)
    # a third dimension without spread has no component
    flat = [(i, [*v, 0.25], y) for i, v, y in clustered(30, 2, 9)]
    assert {r.component for r in W.whitened(make_vectors(flat)).collect()} == {1, 2}
    assert W.whitened(make_vectors([(1, [0.5, 0.5], 1)] * 3)).collect() == []
    assert W.whitened(make_vectors([])).collect() == [] and W.whitened(make_vectors([(1, None, 1), (2, [], 1)])).collect() == []


def test_whitening_of_large_entries_and_repeats(make_vectors):
    rows = [(i, [float(2**30 + 3 * i), float(i * i % 7) * 2.0**28], 1) for i in range(20)]
    got = W.whitened(make_vectors([*rows, rows[0]], "DOUBLE")).collect()
    assert len(got) == 42 and got[0].n == 21 and got[0].identity_error < 1e-6
    x = [[math.floor(1024 * c) for c in v] for _, v, _ in [*rows, rows[0]]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    wanted = sum((21 * a - b) ** 2 for a, b in zip(x[3], sums, strict=True))
    assert {r.deviation for r in got if r.vec_id == 3} == {wanted if wanted < 2**63 else None}
