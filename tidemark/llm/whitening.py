"""Embedding whitening by FEAST contour integration.

The covariance comes from exact integer sums. Its leading eigenvalues are covered by a few intervals, which are cut at
wide gaps by counts of eigenvalues (Sylvester's inertia of the shifted matrix). For each interval the resolvent
(z - V)^-1 Y is integrated around a circle through its ends: one complex solve per interval and quadrature node, each a
task of its own. This projects Y onto the interval's eigenvectors; Rayleigh-Ritz extracts them, and the projection is
repeated until residuals are at rounding level. An interval must yield as many eigenvalues as inertia counts in it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pivots import whole_vector

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: The covariance and the subspaces are on the driver and in each solving task: dims x dims numbers, which this bounds.
MOST_DIMS = 2_048
#: Eigenvalues that one contour encloses, about, and nodes on its upper half.
PER_INTERVAL, NODES = 8, 8
ROUNDS = 40
#: Entries of floor(64 * c) up to which sums of products are exact in 64 bits, by blocks.
MOST = 2**31


# ---- counts of eigenvalues


def tridiagonal(matrix) -> tuple:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, by Householder reflections."""
    import numpy as np

    a, n = matrix.copy(), len(matrix)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += math.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(band: tuple, shift: float) -> int:
    """How many eigenvalues are above a shift: the positive pivots of T - shift, in number those of V - shift."""
    diagonal, off = band
    scale = max(abs(diagonal).max(), abs(off).max() if len(off) else 0.0, 1e-300)
    count, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < 1e-300 + 2.0**-104 * scale:
            pivot = -(2.0**-104) * scale
        count += pivot > 0
    return count


def rounding_level(matrix) -> float:
    """What an eigenvalue must be above to count."""
    return float(abs(matrix).sum(axis=1).max()) * 1e-12


def bracket(band: tuple, rank: int, low: float, high: float, width: float) -> tuple[float, float]:
    """An interval as narrow as ``width`` with the rank-th largest eigenvalue."""
    while high - low > width:
        middle = (low + high) / 2
        low, high = (middle, high) if above(band, middle) >= rank else (low, middle)
    return low, high


def intervals(matrix, wanted: int, per: int = PER_INTERVAL) -> tuple[list[tuple[float, float, int]], tuple]:
    """[(low, high, eigenvalues in it)] from the top down, which together hold the leading ``wanted`` eigenvalues above rounding level, and the band they were counted in.

    They end at a gap much wider than others near it, else at the widest within a few ranks of every ``per``-th
    eigenvalue. Ends lie close to the eigenvalues, for a circle much wider than them would tell its ends' neighbours
    apart badly; inertia proves that none lies between two intervals.
    """
    band = tridiagonal(matrix)
    radius = float(abs(matrix).sum(axis=1).max())
    top = radius * (1 + 1e-9)
    rank, n, least = above(band, rounding_level(matrix)), len(matrix), radius * 1e-6
    wanted = min(wanted, rank)
    place = lambda j: sum(bracket(band, j, -top, top, radius * 1e-7)) / 2 if 1 <= j <= n else math.copysign(math.inf, 1 - j)
    out, taken, first, before = [], 0, place(1), math.inf
    while taken < wanted:
        goal = min(taken + per, wanted)
        # An eigenvalue beyond those wanted may be enclosed, if the gap there is wider.
        at = [first, *[place(j) for j in range(taken + 2, min(goal + per // 2, n) + 2)]]
        gaps = [a - b for a, b in zip(at, at[1:])]
        wide = max(8 * sorted(gaps)[len(gaps) // 2], 100 * least)
        last = next((j for j in range(goal - taken - 1) if gaps[j] > wide), None)
        if last is None:
            last = max(range(goal - taken - 1, len(gaps)), key=lambda j: gaps[j])
        room = max(least, 0.1 * (first - at[last]))
        low, high = at[last] - min(room, gaps[last] / 2), first + min(room, before / 2)
        count = above(band, low) - taken
        if above(band, high) != taken or count <= 0:
            raise ArithmeticError("no gap between eigenvalues to cut at")
        out.append((low, high, count))
        taken, first, before = taken + count, at[last + 1], gaps[last]
    return out, band


# ---- contour integration


def nodes(low: float, high: float, count: int = NODES) -> list[tuple[complex, complex]]:
    """(shift, weight) on the upper half of the circle through the ends; the lower half is its mirror."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(count)
    radius, out = (high - low) / 2, []
    for xi, wi in zip(x, w):
        turn = np.exp(1j * math.pi / 2 * (1 - xi))
        out.append((complex((low + high) / 2 + radius * turn), complex(wi / 2 * radius * turn)))
    return out


def project(spark, matrix, subspaces: dict[int, object], spans: list[tuple]) -> dict[int, object]:
    """The contour integral of each interval applied to its subspace. A row per interval and node; every task solves its own."""
    import numpy as np
    import pandas as pd

    held = spark.sparkContext.broadcast((matrix, subspaces))
    rows = [(k, j, z.real, z.imag, w.real, w.imag) for k in subspaces for j, (z, w) in enumerate(nodes(spans[k][0], spans[k][1]))]

    def solve(frames):
        v, bases = held.value
        for frame in frames:
            out = []
            for k, j, zr, zi, wr, wi in frame.itertuples(index=False, name=None):
                part = np.linalg.solve(complex(zr, zi) * np.eye(len(v)) - v, bases[k].astype(complex))
                out.append((k, j, (complex(wr, wi) * part).real.astype("<f8").tobytes()))
            yield pd.DataFrame(out, columns=["k", "j", "part"])

    plan = spark.createDataFrame(rows, "k int, j int, zr double, zi double, wr double, wi double").repartition(len(rows), "k", "j")
    parts = sorted(plan.mapInPandas(solve, "k int, j int, part binary").collect(), key=lambda r: (r["k"], r["j"]))
    held.destroy()
    return {k: sum(np.frombuffer(r["part"], "<f8").reshape(subspaces[k].shape) for r in parts if r["k"] == k) for k in subspaces}


def ritz(matrix, basis):
    """Ritz values and vectors of a basis, values falling. Directions that the integral has left at rounding level are noise and go."""
    import numpy as np

    q, gain, _ = np.linalg.svd(basis, full_matrices=False)
    q = q[:, gain > 1e-10 * gain[0]]
    values, inner = np.linalg.eigh(q.T @ matrix @ q)
    return values[::-1], (q @ inner)[:, ::-1]


def leading(matrix, wanted: int, run: Callable, rounds: int = ROUNDS):
    """(eigenvalues, eigenvectors as columns), the leading ``wanted`` ones above rounding level, falling.

    ``run(matrix, subspaces, intervals)`` applies the contour integrals. Raises if an interval keeps failing to give
    as many eigenvalues as inertia counts, or residuals stay above rounding level.
    """
    import numpy as np

    if not matrix.any() or not wanted:
        return np.zeros(0), np.zeros((len(matrix), 0))
    spans, band = intervals(matrix, wanted)
    norm, draw = np.linalg.norm(matrix), np.random.default_rng(13)
    open_ = {k: draw.standard_normal((len(matrix), min(len(matrix), math.ceil(1.5 * m) + 2))) for k, (_, _, m) in enumerate(spans)}
    found: dict[int, object] = {}
    for _ in range(rounds):
        for k, integral in run(matrix, open_, spans).items():
            low, high, m = spans[k]
            values, vectors = ritz(matrix, integral)
            off = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
            done = (values > low) & (values <= high) & (off <= 1e-13 * norm)
            if done.sum() == m:
                found[k] = vectors[:, done]
                del open_[k]
            else:
                open_[k] = vectors if vectors.shape[1] >= m else np.concatenate([vectors, draw.standard_normal((len(matrix), m))], axis=1)[:, : len(matrix)]
        if not open_:
            break
    if open_:
        raise ArithmeticError(f"intervals without all eigenvalues that inertia counts: {[spans[k] for k in open_]}")
    # Once more over all intervals together, so that vectors of neighbouring ones are orthogonal to rounding level.
    values, vectors = ritz(matrix, np.concatenate([found[k] for k in sorted(found)], axis=1))
    for low, _, _ in spans:
        if above(band, low) != (values > low).sum():
            raise ArithmeticError("eigenvalues are missing")
    # The last interval may enclose eigenvalues at rounding level; those are no components.
    keep = min(wanted, above(band, rounding_level(matrix)), len(values))
    return values[:keep], vectors[:, :keep]


# ---- the table's side


def _rows(batches, dims: int):
    """Arrow batches with their rows of floor(64 * c)."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(batch.schema.get_field_index("y")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def products(y):
    """Exact sums of products of the columns, as an array of Python integers."""
    import numpy as np

    most = int(np.abs(y).max(initial=0))
    if len(y) * most * most < 2**53:
        x = y.astype(float)
        return (x.T @ x).astype(np.int64).astype(object)
    step = max(1, 2**62 // (most * most))
    return sum(((y[i : i + step].T @ y[i : i + step]).astype(object) for i in range(0, len(y), step)), np.zeros((y.shape[1],) * 2, object))


@dataclass(frozen=True)
class Moments:
    """Rows, sums and sums of products of y; of x = y + SHIFT the covariance and n * x - S are the same."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def covariance(self):
        """Each entry the exact quotient, rounded once."""
        import numpy as np

        d = len(self.sums)
        return np.array([[(self.n * self.products[i][j] - self.sums[i] * self.sums[j]) / (self.n * self.n) for j in range(d)] for i in range(d)], dtype=float).reshape(d, d)


def moments(kept: DataFrame, dims: int) -> Moments:
    """A task sends one row for each pair of dimensions."""

    def run(batches):
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        total = np.zeros((dims + 1, dims), dtype=object)
        n = 0
        for _, y in _rows(batches, dims):
            n += len(y)
            total[:dims] += products(y)
            total[dims] += y.sum(axis=0).astype(object)
        at = [(i, j) for i in range(dims + 1) for j in range(i if i < dims else 0, dims)] if n else []
        columns = [[i for i, _ in at] + [-1], [j for _, j in at] + [0], [Decimal(int(total[i, j])) for i, j in at] + [Decimal(n)]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.decimal128(38, 0))], names=["i", "j", "total"])

    summed = kept.select("y").mapInArrow(run, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    totals = {(r[0], r[1]): int(r[2]) for r in summed.collect()}
    pair = lambda i, j: totals.get((min(i, j), max(i, j)), 0)
    return Moments(totals.get((-1, 0), 0), [totals.get((dims, j), 0) for j in range(dims)], [[pair(i, j) for j in range(dims)] for i in range(dims)])


def _project(y, found: Moments, loadings):
    """Whitened rows, and the exact n * x - S."""
    import numpy as np

    most = found.n * int(np.abs(y).max(initial=0)) + max(map(abs, found.sums), default=0)
    kind = np.int64 if most * most * max(1, y.shape[1]) < 2**63 else object
    centred = found.n * y.astype(kind) - np.array(found.sums, dtype=kind)
    return (centred / found.n).astype(float) @ loadings, centred


def identity_error(kept: DataFrame, found: Moments, loadings) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, from a pass over all rows."""
    import numpy as np

    dims, m = loadings.shape

    def run(batches):
        import pyarrow as pa

        total = np.zeros((m + 1, m))
        for _, y in _rows(batches, dims):
            w, _ = _project(y, found, loadings)
            total[:m] += w.T @ w
            total[m] += w.sum(axis=0)
        at = np.argwhere(np.ones_like(total))
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(total.ravel())], names=["i", "j", "total"])

    summed = np.zeros((m + 1, m))
    for r in kept.select("y").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        summed[r["i"], r["j"]] = r["total"]
    # The rows are centred already; what rounding left of their means is taken out.
    mean = summed[m] / found.n
    return float(abs(summed[:m] / found.n - np.outer(mean, mean) - np.eye(m)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per kept vector and component.

    ``vectors`` needs vec_id and embedding; other columns are not read. Rows are dropped whose vector is null, holds a
    null or non-finite entry, or has another length than most (of equally frequent lengths the longest counts; an empty
    vector has no entries to whiten). Repeated rows count as often as they stand; a null vec_id is kept. Entries so
    large that floor(64 * c) passes 2**31 end the job with an error. Components are numbered from 1 by falling
    eigenvalue; there are as many as the covariance has eigenvalues above rounding level, ``components`` at most, so
    vectors that are all equal, or an empty table, give no rows. Equal eigenvalues share a space, of which one
    orthonormal basis is taken.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = vectors.select("vec_id", "embedding").where(whole_vector(F.col("embedding")) & (F.size("embedding") > 0))
    common = whole.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["dims"]
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of up to {MOST_DIMS} dimensions")
    scaled = F.transform("embedding", lambda c: c.cast("double") * scale)
    y = F.when(F.forall(scaled, lambda c: F.abs(c) < MOST), F.transform(scaled, lambda c: F.floor(c))).otherwise(F.raise_error(F.lit("an entry is too large for exact sums")).cast("array<bigint>"))
    kept = whole.where(F.size("embedding") == dims).select("vec_id", y.alias("y"))

    found = moments(kept, dims)
    covariance = found.covariance()
    values, basis = leading(covariance, components, lambda v, bases, spans: project(spark, v, bases, spans))
    if not len(values):
        return spark.createDataFrame([], schema)
    loadings = basis / values**0.5
    error, explained, n, m = identity_error(kept, found, loadings), values / covariance.trace(), found.n, len(values)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, rows in _rows(batches, dims):
            for i in range(0, len(rows), 2_048):
                w, centred = _project(rows[i : i + 2_048], found, loadings)
                k = len(w)
                deviation = pa.array([int(x) for x in (centred * centred).sum(axis=1)], pa.int64())
                each = pa.array(np.repeat(np.arange(k), m))
                columns = [batch.column(0).slice(i, k).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n)), deviation.take(each), pa.array(w.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, schema)
