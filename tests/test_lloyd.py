"""k-means, elbow and principal components against plain numpy, under other
partitionings and row orders, with nulls, repeated rows, few rows and none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonestats.operators import lloyd
from zonestats.operators.cluster import GRID, elbow, kmeans_labels, pca2, principal_axes

COLS = ["a", "b", "c"]
R = np.random.default_rng(4)
POINTS = np.round(np.concatenate([R.normal(m, 0.6, (150, 3)) for m in (-2.0, 0.0, 1.5)] + [R.normal(0, 3, (40, 3))]), 6)


def frame(spark, points=POINTS, parts=4, order=None):
    rows = [(int(i), *map(float, p), "x") for i, p in enumerate(points)]
    rows = [rows[i] for i in order] if order is not None else rows
    return spark.createDataFrame(rows + [(9999, None, 1.0, 2.0, "x")], "id long, a double, b double, c double, key string").repartition(parts)


def plain(points, k, seed=42, steps=300):
    """The same draws and steps on one array."""
    x = np.rint(points * GRID).astype(np.int64)
    keys, seeds = np.arange(len(x)), []
    for m in range(k):
        time = -np.log(lloyd.uniform(keys, seed + m))
        if seeds:
            far = np.min([((x - s) ** 2).sum(axis=1) for s in seeds], axis=0)
            time = np.where(far > 0, time / np.maximum(far, 1e-300), np.inf)
        if not np.isfinite(time.min()):
            break
        seeds.append(x[np.argmin(time)].astype(float))
    c = np.array(seeds)
    for _ in range(steps):
        label = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(len(c))])
        shift, c = ((new - c) ** 2).sum(), new
        if shift <= 1e-4 * x.var(axis=0).mean():
            break
    c = c[np.lexsort(c.T[::-1])]
    near = ((x[:, None] - c) ** 2).sum(axis=2)
    return near.argmin(axis=1), near.min(axis=1).sum() / GRID**2


@pytest.mark.parametrize("k", [1, 4])
def test_labels_are_the_plain_ones_whatever_the_layout(spark, k):
    want, _ = plain(POINTS, k)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, order in ((8, None), (40, R.permutation(len(POINTS))), (3, range(len(POINTS) - 1, -1, -1))):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = kmeans_labels(frame(spark, parts=parts, order=order), COLS, k=k, key="id")
            assert got.columns == ["id", *COLS, "key", "cluster"]
            assert {r["id"]: r["cluster"] for r in got.collect()} == dict(enumerate(want.tolist()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_elbow_is_the_plain_one(spark):
    got = {r["k"]: r["inertia"] for r in elbow(frame(spark), COLS, ks=[2, 3, 5], key="id").collect()}
    assert list(got) == [2, 3, 5]
    for k, v in got.items():
        assert v == pytest.approx(plain(POINTS, k)[1], rel=1e-9)


def test_fewer_rows_than_centres(spark):
    points = np.array([[0.0, 0, 0], [1, 1, 1], [1, 1, 1], [0, 0, 0]])
    got = kmeans_labels(frame(spark, points), COLS, k=4).collect()
    assert {r["id"]: r["cluster"] for r in got} == {0: 0, 3: 0, 1: 1, 2: 1}
    assert [r["inertia"] for r in elbow(frame(spark, points), COLS, ks=[2, 4]).collect()] == [0.0, 0.0]
    none = frame(spark, points[:0])
    assert kmeans_labels(none, COLS).collect() == [] and elbow(none, COLS).collect() == [] and pca2(none, COLS).collect() == []


def test_spread_of_large_values_is_exact(spark):
    x = [(1 << 40) + 7, -(1 << 39), 3, 12_345_678_901]
    rows = spark.createDataFrame([(i, v, -v) for i, v in enumerate(x * 500)], "k long, a long, b long")
    n, total, square = lloyd.spread(lloyd.blocks(rows, "k", ["a", "b"]), 2)
    assert (n, total, square) == (2000, [500 * sum(x), -500 * sum(x)], [500 * sum(v * v for v in x)] * 2)
    got = lloyd.label_sums(lloyd.blocks(rows, "k", ["a", "b"]), {0: [[0.0, 0.0]], 1: [[1e9, -1e9], [-1e11, 1e11]]})
    assert got[0] == [(2000, [500 * sum(x), -500 * sum(x)])]
    assert got[1] == [(1500, [500 * (sum(x) + (1 << 39)), -500 * (sum(x) + (1 << 39))]), (500, [-500 << 39, 500 << 39])]


def test_axes_are_the_eigenvectors():
    for d in (1, 2, 5, 9):
        m = R.normal(size=(d, d))
        cov = m @ m.T
        values, axes = principal_axes(cov.tolist())
        e, v = np.linalg.eigh(cov)
        np.testing.assert_allclose(values, e[::-1], rtol=1e-10)
        for axis, want in zip(axes, v.T[::-1]):
            assert max(axis, key=abs) > 0
            np.testing.assert_allclose(np.abs(np.dot(axis, want)), 1.0, rtol=1e-10)


def test_scores_are_the_plain_ones(spark):
    got = {r["id"]: (r["PC1"], r["PC2"]) for r in pca2(frame(spark), COLS).collect()}
    x = POINTS - POINTS.mean(axis=0)
    v = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :2]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), [0, 1]])
    np.testing.assert_allclose([got[i] for i in range(len(POINTS))], x @ v, atol=1e-8)


def test_uniform_draws_spread():
    for keys in (np.arange(20_000), R.integers(-2**62, 2**62, 20_000)):
        u = np.stack([lloyd.uniform(keys, d) for d in (0, 1, 42)])
        assert (u > 0).all() and (u < 1).all()
        assert np.abs(np.histogram(u, 20, (0, 1))[0] / u.size - 0.05).max() < 0.01
        assert abs(np.corrcoef(u)[0, 1]) < 0.05
