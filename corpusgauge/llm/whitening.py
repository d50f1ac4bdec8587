"""Whiten embeddings by the exact characteristic polynomial of their scatter matrix.

Entries become whole numbers, so the scatter ``M = n * sum(x x') - S S'`` (that is, n^2
times the covariance) is an integer matrix, summed exactly over all rows.

1. *Polynomial.*  Modulo each of enough primes ``M`` is brought to Hessenberg form and its
   characteristic polynomial read off, a prime a row of a Spark job; Chinese remaindering
   puts the integer coefficients together.
2. *Roots.*  All roots of a symmetric matrix are real, and for such a polynomial
   Descartes' rule is exact: the sign changes of ``p(x + a)`` are the roots above ``a``, each
   as often as it is one.  Bisection on that count encloses each root, in whole numbers,
   to ``ROOT_BITS`` bits below the whole ones.
3. *Vectors.*  Inverse iteration with the shifted matrix finds its null space; residuals
   in exact whole numbers refine the vector beyond double precision.  Vectors of one
   multiple (or nearly so) root are made orthogonal to each other.

``M`` and what follows is bounded by the number of dimensions, not by the rows.

Rows with a null vector or a null or non-finite entry are dropped.  Vectors shorter than
the longest count as filled up with zeros.  Repeated rows count as often as they stand, a
null id is kept.  There are as many components as dimensions, ``components`` at most;
those of eigenvalue 0 have no whitened value and are left out.  A ``deviation`` beyond a
long is null.  Where no row remains, or all are equal, there are no rows.  Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm.frames import map_batches

SCALE, OFFSET = 1024, 100_000
#: Bits below the whole ones to which a root of the scatter matrix is enclosed.
ROOT_BITS = 64
#: Roots nearer to each other than this share of the greatest one share a space.
CLUSTER = 1e-9
#: Bits of the whole-number vectors that residuals are taken of.
VECTOR_BITS = 160
#: Low part of a sum that is carried as two decimals.
_LOW = 1 << 60


# --- exact sums ------------------------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, c`` of the rows that remain, as doubles."""
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.filter(F.col("embedding").isNotNull()).filter(~odd)
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    """``floor(SCALE * c)`` as rows of ``dim`` doubles, which hold it exactly."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = np.asarray(column.flatten(), dtype=np.float64)
    return np.floor(SCALE * out)


def _exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers as Python's, which never overflow."""
    out = np.empty(values.shape, dtype=object)
    out.ravel()[:] = [int(v) for v in values.ravel()]
    return out


def _products(y: np.ndarray) -> np.ndarray:
    """``y' y`` exactly."""
    most = float(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < 1 << 53:
        return _exact(y.T @ y)
    whole = _exact(y)
    return whole.T.dot(whole)


@dataclass(frozen=True)
class Moments:
    """Number of vectors, and exact sums of entries and of their products, less OFFSET."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def scatter(self) -> list[list[int]]:
        d = range(len(self.sums))
        return [[self.n * self.products[i][j] - self.sums[i] * self.sums[j] for j in d] for i in d]


def moments(rows: DataFrame) -> Moments | None:
    """Exact sums over all rows; each task sends one row for each pair of dimensions."""
    dim, n = rows.agg(F.max(F.size("c")), F.count(F.lit(1))).first()
    if not dim:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = _whole(batch.column("c"), dim)
            # the ones give the sums
            y = np.hstack([y, np.ones((len(y), 1))])
            total = _products(y) if total is None else total + _products(y)
        if total is not None:
            at = [(i, j) for i in range(dim + 1) for j in range(i, dim + 1)]
            low = [int(total[p]) % _LOW for p in at]
            # the high part may itself be beyond a long
            high = [str(int(total[p]) // _LOW) for p in at]
            i, j = zip(*at, strict=True)
            yield pa.record_batch(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high), pa.array(low, pa.int64())],
                names=["i", "j", "high", "low"],
            )

    parts = map_batches(rows.select("c"), add, "i INT, j INT, high STRING, low BIGINT")
    wide = "decimal(38,0)"
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    total = [[0] * (dim + 1) for _ in range(dim + 1)]
    for r in summed.collect():
        total[r["i"]][r["j"]] = total[r["j"]][r["i"]] = int(r["high"]) * _LOW + int(r["low"])
    return Moments(n, total[dim][:dim], [line[:dim] for line in total[:dim]])


# --- characteristic polynomial -----------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that are exact below 3 * 10**9."""
    if n < 49:
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return n % 2 == 1


def primes_below(top: int, bits: float) -> list[int]:
    """The greatest primes below ``top`` whose product has more than ``bits`` bits."""
    out: list[int] = []
    while bits >= 0:
        top -= 1
        if is_prime(top):
            out.append(top)
            bits -= math.log2(top)
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients modulo ``p`` (below 2**31) of ``det(x I - matrix)``, lowest first."""
    h, d = matrix.astype(np.int64) % p, len(matrix)
    for k in range(1, d - 1):
        pivots = np.flatnonzero(h[k:, k - 1])
        if not len(pivots):
            continue
        r = k + int(pivots[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        # similarity: rows lose a multiple of row k, column k gains as much of theirs
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    found = np.zeros((d + 1, d + 1), dtype=np.int64)
    found[0, 0] = 1
    for k in range(1, d + 1):
        found[k, 1:] = found[k - 1, :-1]
        found[k] = (found[k] - h[k - 1, k - 1] * found[k - 1] % p) % p
        product = 1
        for i in range(1, k):
            product = product * int(h[k - i, k - i - 1]) % p
            if not product:
                break
            found[k] = (found[k] - product * int(h[k - i - 1, k - 1]) % p * found[k - i - 1] % p) % p
    return found[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of ``det(x I - matrix)``, lowest first; ``matrix`` is symmetric
    without negative eigenvalues."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # all coefficients are below the product of (1 + eigenvalue), which their mean bounds
    bits = d * math.log2(1 + trace // d + 1) + 2
    primes = primes_below(1 << 31, bits)
    shared = spark.sparkContext.broadcast(matrix)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column("p").to_pylist()
            found = [polynomial_mod(np.array([[v % p for v in line] for line in shared.value], dtype=np.int64), p) for p in ps]
            yield pa.record_batch([pa.array(ps, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "coefficients"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p BIGINT").repartition(tasks)
    residues = {r["p"]: r["coefficients"] for r in map_batches(rows, reduce, "p BIGINT, coefficients ARRAY<BIGINT>").collect()}
    product = math.prod(primes)
    out = [0] * (d + 1)
    for p in primes:
        rest = product // p
        unit = rest * pow(rest, -1, p)
        out = [a + unit * r for a, r in zip(out, residues[p], strict=True)]
    # a residue in the upper half stands for a negative coefficient
    return [v - product if 2 * v > product else v for v in (a % product for a in out)]


# --- roots and vectors ---------------------------------------------------------------------------


def roots_above(coefficients: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are greater than ``at``."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def greatest_roots(coefficients: list[int], k: int, bound: int, bits: int = ROOT_BITS) -> list[int]:
    """The ``k`` greatest roots in falling order, each less than 1 below the value given,
    in units of ``2**-bits``; ``bound`` is no less than any."""
    d = len(coefficients) - 1
    # the polynomial whose roots are 2**bits times as great
    scaled = [c << (bits * (d - i)) for i, c in enumerate(coefficients)]
    counts: dict[int, int] = {}

    def above(at: int) -> int:
        if at not in counts:
            counts[at] = roots_above(scaled, at)
        return counts[at]

    out = []
    for i in range(k):
        # more than i roots lie above low, i at most above high
        low, high = -1, (out[-1] if out else (bound << bits) + 1)
        for at, n in counts.items():
            if n > i:
                low = max(low, at)
            else:
                high = min(high, at)
        while high - low > 1:
            middle = (low + high) // 2
            if above(middle) > i:
                low = middle
            else:
                high = middle
        out.append(high)
    return out


def _refined(matrix: np.ndarray, exact: np.ndarray, root: int, bits: int, v: np.ndarray) -> tuple[np.ndarray, int]:
    """A unit eigenvector near ``v``, refined with exact residuals, and its root."""
    d, one = len(v), 1 << VECTOR_BITS
    scale = float(np.abs(matrix).max())
    fixed = _exact(np.round(v * float(1 << 52))) * (one >> 52)
    value = root << (VECTOR_BITS - bits)
    for _ in range(8):
        # M v - value v, in units of 2**-VECTOR_BITS
        residual = exact.dot(fixed) - np.array([value * int(x) >> VECTOR_BITS for x in fixed], dtype=object)
        missing = (one - (sum(int(x) * int(x) for x in fixed) >> VECTOR_BITS)) // 2
        most = max(max(abs(int(r)) for r in residual), abs(missing) * max(1, int(scale)), 1)
        shift = max(0, most.bit_length() - 900)
        unit = np.array([float(int(x) >> (VECTOR_BITS - 52)) for x in fixed]) / float(1 << 52)
        near = float(value >> (VECTOR_BITS - 30)) / float(1 << 30)
        bordered = np.zeros((d + 1, d + 1))
        bordered[:d, :d] = (matrix - near * np.eye(d)) / scale
        bordered[:d, d], bordered[d, :d] = -unit, unit
        right = np.array([-float(int(r) >> shift) / scale for r in residual] + [float(missing >> shift)])
        step = np.linalg.solve(bordered, right)
        fixed = fixed + np.array([int(x) << shift for x in step[:d]], dtype=object)
        value += int(step[d] * scale) << shift
        if most < one >> 90:
            break
    return np.array([float(int(x)) for x in fixed]) / float(one), value >> (VECTOR_BITS - bits)


def eigenvectors(scatter: list[list[int]], roots: list[int], bits: int = ROOT_BITS) -> np.ndarray:
    """Unit vectors of the given roots, a row each."""
    d = len(scatter)
    exact = np.array(scatter, dtype=object).reshape(d, d)
    # a power of two common to all entries changes no vector and keeps doubles in range
    down = max(0, max(abs(int(v)) for v in exact.ravel()).bit_length() - 500)
    matrix = np.array([[float(v >> down) for v in line] for line in scatter])
    values = [float(r >> (down + bits - 40)) / float(1 << 40) for r in roots]
    rng = np.random.default_rng(5)
    scale = float(np.abs(matrix).max())
    out: list[np.ndarray] = []
    for i, value in enumerate(values):
        near = [k for k in range(i) if abs(values[k] - value) <= CLUSTER * values[0]]
        # a little off the root, or the system may be exactly singular
        shifted = matrix - (value + 2e-15 * scale) * np.eye(d)
        v = rng.normal(size=d)
        for _ in range(6):
            for k in near:
                v = v - (v @ out[k]) * out[k]
            try:
                v = np.linalg.solve(shifted, v / np.linalg.norm(v))
            except np.linalg.LinAlgError:
                shifted = shifted - 1e-14 * scale * np.eye(d)
        for k in near:
            v = v - (v @ out[k]) * out[k]
        v = v / np.linalg.norm(v)
        alone = all(abs(values[k] - value) > CLUSTER * values[0] for k in range(len(values)) if k != i)
        if alone and not down:
            refined, _ = _refined(matrix, exact, roots[i], bits, v)
            # a root that the list ends before may be as near; then the step is not to be trusted
            if np.all(np.isfinite(refined)) and abs(refined @ v) > 0.999999:
                v = refined
        out.append(v)
    return np.array(out).reshape(len(roots), d)


# --- whitening -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: its moments, eigenvalues of the covariance and their vectors."""

    moments: Moments
    values: list[float]
    explained: list[float]
    vectors: np.ndarray

    def centred(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n y - S`` as doubles, and exactly as longs or Python's numbers."""
        n, sums = self.moments.n, self.moments.sums
        most = max(float(np.abs(y).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
        if most < 1 << 52:
            exact = y.astype(np.int64) * n - np.array(sums, dtype=np.int64)
        else:
            exact = _exact(y) * n - np.array(sums, dtype=object)
        return exact.astype(np.float64), exact

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred / self.moments.n @ self.vectors.T / np.sqrt(self.values)


def fit(embeddings: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of all rows; None without rows or spread."""
    spark = embeddings.sparkSession
    found = moments(usable(embeddings))
    if found is None:
        return None
    scatter = found.scatter()
    trace = sum(scatter[i][i] for i in range(len(scatter)))
    if not trace:
        return None
    # a common factor of all entries only makes numbers longer
    factor = math.gcd(*(v for line in scatter for v in line))
    small = [[v // factor for v in line] for line in scatter]
    coefficients = characteristic_polynomial(spark, small)
    rank = len(small) - next(i for i, c in enumerate(coefficients) if c)
    roots = greatest_roots(coefficients, min(components, rank), trace // factor)
    vectors = eigenvectors(small, roots)
    unit = 1 << ROOT_BITS
    values = [r * factor / (unit * found.n**2) for r in roots]
    explained = [r * factor / (unit * trace) for r in roots]
    return Whitening(found, values, explained, vectors)


_RESULT = (
    "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"
)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity."""
    dim, k = len(model.moments.sums), len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.whitened(model.centred(_whole(batch.column("c"), dim))[0])
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        at = [(i, j) for i in range(k + 1) for j in range(k)]
        i, j = zip(*at, strict=True)
        yield pa.record_batch(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([float(total[p]) for p in at])], names=["i", "j", "v"]
        )

    summed = map_batches(rows.select("c"), add, "i INT, j INT, v DOUBLE").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1, k))
    for r in summed.collect():
        total[r["i"], r["j"]] = r["v"] / model.moments.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for
    each remaining row of ``embeddings`` and component."""
    model = fit(embeddings, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _RESULT)
    rows = usable(embeddings)
    error = identity_error(rows, model)
    dim, k, n = len(model.moments.sums), len(model.values), model.moments.n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred, exact = model.centred(_whole(batch.column("c"), dim))
            if float(np.abs(centred).max(initial=0)) ** 2 * dim < 1 << 62:
                deviation = (exact * exact).sum(axis=1).tolist()
            else:
                deviation = [sum(int(v) ** 2 for v in line) for line in exact]
                deviation = [v if v < 1 << 63 else None for v in deviation]
            rows_ = np.repeat(np.arange(len(centred)), k)
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(pa.array(rows_)),
                    pa.array(np.tile(np.arange(1, k + 1), len(centred)), pa.int32()),
                    pa.array(np.full(len(rows_), n)),
                    pa.array(deviation, pa.int64()).take(pa.array(rows_)),
                    pa.array(model.whitened(centred).ravel()),
                    pa.array(np.tile(model.explained, len(centred))),
                    pa.array(np.full(len(rows_), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_batches(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "c"), project, _RESULT)
