"""Centroid clustering with Ptolemaic pivots.

In Euclidean space d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| for any x, c, p and s. Distances of all
vectors to a few pivots are worked out once and kept beside them; in each round the distances of the centroids to the
pivots are added on the driver, and fixed pairs of pivots then bound every distance from below. A vector is measured
exactly against the centroid with the least bound first, and then against those whose bound does not exceed what it
has found. Bounds are rounded down by more than their error, so the result is that of measuring everything.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

CLUSTERS, ROUNDS, SCALE, DIMS = 8, 10, 1024, 64
#: Vectors of the least hashes, from which pivots and their pairs are chosen. A bound of what the driver holds, and no more: all vectors are measured.
SAMPLE = 1_024
PIVOTS, PAIRS = 12, 8
#: Relative rounding errors of a bound are a few 2**-53; it is lowered by many times that.
SLACK = 2.0**-46


def whole_vector(vector: Column) -> Column:
    """Whether a vector has no null and no non-finite entry; false for a null vector."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


@dataclass(frozen=True)
class Pivots:
    """Pivot vectors, and the pairs of them that give bounds."""

    vectors: list[list[int]]
    pairs: list[tuple[int, int]]

    def to_pivots(self, rows):
        """Exact squared distances of integer rows to all pivots."""
        import numpy as np

        return np.stack([((rows - np.asarray(p, dtype=np.int64)) ** 2).sum(axis=1) for p in self.vectors], axis=1) if self.vectors else np.zeros((len(rows), 0), np.int64)


def lower_bounds(near, far, spread, pairs):
    """Squared distances of vectors to centroids, from below: near is vectors x pivots, far is centroids x pivots, spread pivots x pivots, all distances."""
    import numpy as np

    least = np.zeros((len(near), len(far)))
    for p, s in pairs:
        a, b = near[:, [p]] * far[:, s], near[:, [s]] * far[:, p]
        np.maximum(least, (np.abs(a - b) - SLACK * (a + b)) / spread[p, s], out=least)
    return least * least * (1 - SLACK)


def nearest(rows, near, centroids, far, spread, pairs):
    """(cluster, exact squared distance, how many exact distances were taken) of integer rows; ties go to the smaller number."""
    import numpy as np

    least = lower_bounds(near, far, spread, pairs)
    label = least.argmin(axis=1)
    best = ((rows - centroids[label]) ** 2).sum(axis=1)
    first, taken = label.copy(), len(rows)
    for c in range(len(centroids)):
        at = np.flatnonzero((least[:, c] <= best * (1 + SLACK)) & (first != c))
        if not len(at):
            continue
        exact, taken = ((rows[at] - centroids[c]) ** 2).sum(axis=1), taken + len(at)
        better = (exact < best[at]) | ((exact == best[at]) & (c < label[at]))
        label[at[better]], best[at[better]] = c, exact[better]
    return label, best, taken


def chosen(sample: list[list[int]], centroids: list[list[int]], pivots: int = PIVOTS, pairs: int = PAIRS) -> Pivots:
    """Pivots far from each other, each as far as possible from those before it, and the pairs that together bound distances of the sample best."""
    import numpy as np

    rows = np.unique(np.asarray(sample, dtype=np.int64), axis=0) if sample else np.zeros((0, 1), np.int64)
    picked, gap = [], None
    while len(rows) and len(picked) < min(pivots, len(rows)):
        at = 0 if gap is None else int(gap.argmax())
        picked.append(rows[at].tolist())
        here = ((rows - rows[at]) ** 2).sum(axis=1)
        gap = here if gap is None else np.minimum(gap, here)
    found = Pivots(picked, [])
    near, far, spread = (np.sqrt(found.to_pivots(np.asarray(x, dtype=np.int64)).astype(float)) for x in (rows, centroids, picked)) if picked else (None,) * 3
    able = {(p, s): lower_bounds(near, far, spread, [(p, s)]) for p in range(len(picked)) for s in range(p)}
    taken, least = [], 0.0
    while able and len(taken) < pairs:
        pair = max(able, key=lambda k: np.maximum(least, able[k]).sum())
        least = np.maximum(least, able.pop(pair))
        taken.append(pair)
    return Pivots(picked, taken)


def _blocks(batches, dims: int) -> Iterator[tuple]:
    """Arrow batches with their integer rows and distances to pivots."""
    import numpy as np

    for batch in batches:
        if batch.num_rows:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
            yield batch, column("x").reshape(batch.num_rows, dims), np.sqrt(column("near").reshape(batch.num_rows, -1).astype(float))


def _with_distances(kept: DataFrame, pivots: Pivots, dims: int) -> DataFrame:
    """Adds ``near``: exact squared distances to the pivots."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                far = pivots.to_pivots(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims))
                near = pa.ListArray.from_arrays(pa.array(range(0, far.size + 1, max(1, far.shape[1])), pa.int32()), pa.array(far.ravel())) if far.size else pa.array([[]] * len(far), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), near], names=["vec_id", "x", "near"])

    return kept.select("vec_id", "x").mapInArrow(run, "vec_id long, x array<long>, near array<long>")


def _assigner(centroids: list[list[int]], pivots: Pivots) -> Callable:
    """rows, near -> nearest() against these centroids."""

    def assign(rows, near):
        import numpy as np

        points = np.asarray(centroids, dtype=np.int64)
        far, spread = (np.sqrt(pivots.to_pivots(np.asarray(x, dtype=np.int64)).astype(float)) for x in (points, pivots.vectors or np.zeros((0, points.shape[1]), np.int64)))
        return nearest(rows, near, points, far, spread, pivots.pairs)

    return assign


def _totals(table: DataFrame, centroids: list[list[int]], pivots: Pivots, dims: int) -> tuple[dict, int]:
    """{(cluster, i): total}: sums of components, at ``dims`` the rows and at dims + 1 the squared distances; and exact distances taken. A task sends one row for each."""
    assign = _assigner(centroids, pivots)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums, work = np.zeros((len(centroids), dims + 2), dtype=np.int64), 0
        for _, rows, near in _blocks(batches, dims):
            label, distance, taken = assign(rows, near)
            work += taken
            for c in np.unique(label):
                mine = label == c
                sums[c] += np.concatenate([rows[mine].sum(axis=0), [mine.sum(), distance[mine].sum()]])
        at = np.argwhere(sums)
        out = [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(sums[at[:, 0], at[:, 1]], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, pa.array([v], a.type)]) for a, v in zip(out, (-1, 0, work))], names=["cluster", "i", "total"])

    found = table.select("x", "near").mapInArrow(run, "cluster int, i int, total long").groupBy("cluster", "i").agg(F.sum("total").alias("total"))
    totals = {(r[0], r[1]): r[2] for r in found.collect()}
    return totals, totals.pop((-1, 0), 0)


@dataclass(frozen=True)
class Clustering:
    """Final centroids and pivots, with the kept vectors' table (vec_id, x, near). ``measured`` is the exact distances taken, ``possible`` what there was to take."""

    centroids: list[list[int]]
    pivots: Pivots
    table: DataFrame
    inertia: list[int]
    measured: int
    possible: int

    def assigned(self, dims: int = DIMS) -> DataFrame:
        """(vec_id, cluster, distance), one row per kept vector."""
        assign = _assigner(self.centroids, self.pivots)

        def run(batches):
            import pyarrow as pa

            for batch, rows, near in _blocks(batches, dims):
                label, distance, _ = assign(rows, near)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

        return self.table.mapInArrow(run, "vec_id long, cluster int, distance long")


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = "3:") -> Clustering:
    """Lloyd's rounds over integer vectors.

    ``vectors`` needs vec_id and embedding; other columns are not read. Vectors that are null, hold a null or non-finite
    entry or have another length than ``dims`` are dropped. Entries become floor(scale * x); one so large that squared
    distances would not fit 64 bits ends the job with an error. Centroids start as the kept vectors of the least
    sha256(salt + vec_id), equal hashes (repeated or null ids, a null counting as no digits) by their components, and
    fewer when fewer are kept. Repeated rows count as often as they stand. An empty table has no centroids.
    """
    most = math.isqrt(2**61 // dims)
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    fits = F.forall(scaled, lambda x: F.abs(x) < most)
    x = F.when(fits, F.transform(scaled, lambda x: F.floor(x))).otherwise(F.raise_error(F.lit("an entry is too large for exact 64-bit distances")).cast("array<bigint>"))
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dims) & whole_vector(F.col("embedding"))).select("vec_id", x.alias("x"))
    place = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    sample = [r["x"] for r in kept.select("x", place.alias("place")).orderBy("place", "x").limit(max(SAMPLE, clusters)).collect()]
    centroids = sample[:clusters]
    pivots = chosen(sample, centroids)
    table = written(_with_distances(kept, pivots, dims), "pivot-distances")
    measured, inertia, passes = 0, [], 0
    for last in [False] * rounds + [True]:
        totals, work = _totals(table, centroids, pivots, dims) if centroids else ({}, 0)
        measured, passes = measured + work, passes + 1
        count = [totals.get((c, dims), 0) for c in range(len(centroids))]
        inertia = [totals.get((c, dims + 1), 0) for c in range(len(centroids))]
        if not last:
            centroids = [[totals.get((c, i), 0) // n for i in range(dims)] if n else before for c, (before, n) in enumerate(zip(centroids, count))]
    return Clustering(centroids, pivots, table, inertia, measured, passes * sum(count) * len(centroids))


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector; see ``fit``."""
    found = fit(vectors, clusters, rounds, dims, scale, salt)
    text = lambda values: F.split(F.lit(",".join(map(str, values))), ",")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    return found.assigned(dims).select(
        "vec_id", "cluster", "distance", F.get(text(found.inertia or [0]).cast("array<bigint>"), F.col("cluster")).alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("long").alias("inertia"), F.get(text(digests), F.col("cluster")).alias("centroid_sha256")
    )
