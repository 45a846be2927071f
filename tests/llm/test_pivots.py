import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm.pivots import centroid_clusters, chosen, fit, lower_bounds, nearest

SCHEMA = "vec_id long, embedding array<float>, cluster string, x long, near string"


def plain(rows, k, rounds, dims):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    final = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, c in final if c == j) for j in range(len(centroids))}
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in final]


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_measuring_everything(spark, seed):
    """Ties (a coarse grid), repeated rows and ids, nulls, other lengths and non-finite entries."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) for _ in range(3)]) for i in range(200)]
    rows += rows[:20] + [(5, [0.1, 0.2, 0.3]), (None, [0.1, 0.2, 0.4]), (None, None), (300, [0.1, None, 0.2]), (301, [0.1, 0.2]), (302, [0.1, float("nan"), 0.2]), (303, [0.1, float("-inf"), 0.2]), (304, [])]
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in centroid_clusters(df, clusters=6, rounds=5, dims=3).collect()]
    assert key(got) == key(plain(rows, 6, 5, 3))


def test_fewer_vectors_than_clusters_and_none(spark):
    one = spark.createDataFrame([(1, [0.5, -0.5], "a", 1, "b")] * 3, SCHEMA)
    got = [tuple(r) for r in centroid_clusters(one, clusters=8, rounds=3, dims=2).collect()]
    assert got == plain([(1, [0.5, -0.5])] * 3, 8, 3, 2) and {r[1:3] for r in got} == {(0, 0)}
    assert centroid_clusters(one.where("vec_id = 2"), dims=2).collect() == []


def test_too_large_an_entry_says_so(spark):
    far = spark.createDataFrame([(1, [1e30, 0.0], "a", 1, "b")], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        centroid_clusters(far, dims=2).collect()


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(5)
    middles = rng.integers(-3000, 3000, (8, 16))
    rows = middles[rng.integers(0, 8, 4000)] + rng.integers(-200, 200, (4000, 16))
    found = chosen(rows[:1000].tolist(), middles.tolist())
    assert len(found.pairs) == 8 and len(set(found.pairs)) == 8
    exact = ((rows[:, None, :] - middles[None]) ** 2).sum(axis=2)
    near, far, spread = (np.sqrt(found.to_pivots(x).astype(float)) for x in (rows, middles, np.asarray(found.vectors)))
    bounds = lower_bounds(near, far, spread, found.pairs)
    assert (bounds <= exact).all()
    label, best, taken = nearest(rows, near, middles, far, spread, found.pairs)
    assert (label == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert taken < 0.5 * exact.size


def test_bounds_are_rounded_down_where_they_are_tight():
    """Points of one line with the pivots at its ends: the inequality is an equation, so any rounding up would show."""
    rng = random.Random(9)
    for _ in range(300):
        step = [rng.randint(-50, 50) for _ in range(5)]
        at = [sorted(rng.sample(range(10**6), 4))]
        p, c, x, s = (np.array([[k * v for v in step]]) for k in at[0])
        d = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=1).astype(float))
        near, far = np.stack([d(x, p), d(x, s)], axis=1), np.stack([d(c, p), d(c, s)], axis=1)
        spread = np.array([[0.0, d(p, s)[0]], [d(p, s)[0], 0.0]])
        if spread[0, 1]:
            assert lower_bounds(near, far, spread, [(0, 1)])[0, 0] <= ((x - c) ** 2).sum()


def test_whole_table_against_plain(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert key(tuple(r) for r in centroid_clusters(df).collect()) == key(plain(rows, 8, 10, 64))
    found = fit(df)
    assert 0 < found.measured <= found.possible
