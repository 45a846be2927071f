import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm.pivots import whole_vector
from tidemark.llm.whitening import above, intervals, leading, nodes, products, tridiagonal, whitened

SCHEMA = "vec_id long, embedding array<float>, component string, n string, y long"


def in_place(matrix, bases, spans):
    """The contour integrals without Spark."""
    return {k: sum((w * np.linalg.solve(z * np.eye(len(matrix)) - matrix, b)).real for z, w in nodes(*spans[k][:2])) for k, b in bases.items()}


def matrices():
    rng = np.random.default_rng(2)
    for n, values in ((40, np.geomspace(1e-3, 50, 40)), (30, np.repeat([1.0, 2.0, 3.0], 10)), (25, np.r_[np.zeros(10), rng.random(15)]), (12, np.ones(12)), (1, [3.0]), (2, [1.0, 1.0 + 1e-9]), (50, np.r_[rng.random(46), 5 + 1e-10 * np.arange(4)])):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        v = q @ np.diag(values) @ q.T
        yield (v + v.T) / 2
    yield np.zeros((4, 4))


@pytest.mark.parametrize("v", list(matrices()), ids=lambda v: str(len(v)))
def test_leading_pairs_equal_a_dense_solver(v):
    exact = np.linalg.eigvalsh(v)[::-1]
    values, vectors = leading(v, 20, in_place)
    rank = int((exact > 1e-11 * max(1e-300, abs(v).sum())).sum())
    assert len(values) == min(20, rank)
    scale = max(1.0, abs(v).max() * len(v))
    assert np.allclose(values, exact[: len(values)], atol=1e-12 * scale, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-11 * scale)


def test_inertia_counts():
    for v in matrices():
        exact, band = np.linalg.eigvalsh(v), tridiagonal(v)
        for shift in (-1.0, 0.31, 1.5, 2.5, 60.0):
            if abs(exact - shift).min() > 1e-9:
                assert above(band, shift) == (exact > shift).sum()
        if v.any():
            spans, _ = intervals(v, 16)
            assert all(m == ((exact > low) & (exact <= high)).sum() for low, high, m in spans)
            assert all(a[0] >= b[1] and not ((exact > b[1]) & (exact <= a[0])).any() for a, b in zip(spans, spans[1:]))
            assert sum(m for *_, m in spans) >= min(16, (exact > 1e-9).sum())


def test_sums_of_products_are_exact_for_large_entries():
    y = np.array([[2**31 - 1, -(2**31) + 1, 3], [2**31 - 5, 2**31 - 1, -7]] * 50, dtype=np.int64)
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
    assert products(y).tolist() == want
    assert products(y[:0]).tolist() == [[0] * 3] * 3


def plain(rows, components):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    return n, [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], centred @ vectors / values**0.5, values / cov.trace()


def check(got, rows, components):
    n, deviation, w, explained = plain(rows, components)
    assert len(got) == len(rows) * w.shape[1]
    table = {(r["vec_id"], r["component"]): r for r in got}
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {max(r["identity_error"] for r in got)} and got[0]["identity_error"] < 1e-9
    for j in range(w.shape[1]):
        mine = np.array([table[i, j + 1]["whitened"] for i, _ in rows])
        sign = np.sign(mine @ w[:, j])
        assert np.allclose(sign * mine, w[:, j], atol=1e-7)
        assert table[rows[0][0], j + 1]["explained"] == pytest.approx(explained[j], rel=1e-9)
    assert all(table[i, 1]["deviation"] == v for (i, _), v in zip(rows, deviation))


def test_whole_table_equals_a_dense_solver(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitened(df).collect(), [(r["vec_id"], r["embedding"]) for r in df.collect()], 32)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).round(3).tolist()) for i in range(60)]
    bad = [(None, None), (70, [0.1, None, 0.2, 0.3, 0.4]), (71, [float("nan")] * 5), (72, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (73, [0.5] * 4), (74, []), (75, [0.5] * 9)]
    df = spark.createDataFrame([(*r, "c", "n", 1) for r in rows + bad], SCHEMA).repartition(7)
    check(whitened(df).collect(), rows, 32)
    # Repeated rows count as often as they stand, null ids are kept, and missing variance gives fewer components.
    flat = [(None, [1.0, 0.0, 2.0]), (None, [1.0, 0.0, 2.0]), (1, [3.0, 0.0, 2.0])]
    got = whitened(spark.createDataFrame([(*r, "c", "n", 1) for r in flat], SCHEMA)).collect()
    assert len(got) == 3 and {r["component"] for r in got} == {1} and got[0]["explained"] == 1.0 and got[0]["n"] == 3
    assert sorted(round(abs(r["whitened"]), 6) for r in got) == [0.707107, 0.707107, 1.414214]
    same = spark.createDataFrame([(1, [1.0, 2.0], "c", "n", 1)] * 4, SCHEMA)
    assert whitened(same).collect() == [] and whitened(same.where("vec_id = 2")).collect() == []
    assert df.where(whole_vector(df["embedding"])).count() == 60 + 3


def test_too_large_an_entry_says_so(spark):
    with pytest.raises(Exception, match="too large"):
        whitened(spark.createDataFrame([(1, [1e20, 0.0], "c", "n", 1)], SCHEMA)).collect()
