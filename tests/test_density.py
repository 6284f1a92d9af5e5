"""The fast Gauss transform of the density against the direct sum."""

import math

import numpy as np
import pandas as pd
import pytest

from zonestats.operators import dist
from zonestats.operators.dist import kde


def _direct(v, w, bw=0.1, grid=1000):
    n = w.sum()
    mean = (v * w).sum() / n
    h = bw * math.sqrt((w * (v - mean) ** 2).sum() / (n - 1))
    x = np.arange(grid) * ((v.max() - v.min()) / (grid - 1)) + v.min()
    x[-1] = v.max()
    y = np.zeros(grid)
    for i in range(0, len(v), 500):
        y += (np.exp(-0.5 * ((x[:, None] - v[None, i:i + 500]) / h) ** 2) * w[i:i + 500]).sum(1)
    return x, y / (n * h * math.sqrt(2 * math.pi))


def _samples():
    rng = np.random.default_rng(8)
    return {
        "normal": rng.normal(5, 2, 5000),
        "uniform": rng.uniform(-1, 1, 3000),
        "long tail": np.concatenate([rng.exponential(1, 4000), [60.0, 400.0]]),
        "far from zero": 1e6 + rng.normal(0, 3, 2000),
        "two heaps": np.concatenate([rng.normal(0, 1e-3, 900), rng.normal(1, 1e-3, 900)]),
        "hot value": np.concatenate([np.full(4000, 2.5), rng.uniform(0, 9, 2000)]),
        "two values": np.array([1.0, 2.0]),
    }


def test_groups_equal_the_direct_sum(spark):
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in _samples().items()])
    got = kde(spark.createDataFrame(pdf).repartition(7), "v", ["g"]).toPandas()
    assert len(got) == 1000 * len(_samples())
    for g, v in _samples().items():
        one = got[got.g == g].sort_values("point")
        x, y = _direct(*np.unique(v, return_counts=True))
        assert np.allclose(one["x"], x, rtol=1e-15)
        # below 1e-250 the kernels themselves lose digits
        seen = y > 1e-250
        # rounding of a distance far from zero, times the slope of the kernel's logarithm, is in both sums
        bound = 1e-9 if g != "far from zero" else 1e-8
        assert np.max(np.abs(one["density"].to_numpy()[seen] / y[seen] - 1)) < bound, g


def test_whole_column_and_other_grids(spark):
    v = _samples()["normal"]
    got = kde(spark.createDataFrame(pd.DataFrame({"v": v})).repartition(5), "v", bw=0.3, grid=57).toPandas().sort_values("point")
    x, y = _direct(*np.unique(v, return_counts=True), 0.3, 57)
    assert np.max(np.abs(got["density"].to_numpy() / y - 1)) < 1e-9


def test_error_bound_of_the_series():
    z = 39 * dist.HALF_WIDTH
    assert z ** dist.TERMS / math.factorial(dist.TERMS) * math.exp(2 * z) < 1e-12


def test_values_are_combined_into_boxes(spark):
    """Ten times the values, no more boxes than the range holds."""
    n = {}
    for size in (2000, 20000):
        rows = spark.range(size).selectExpr(f"id * 1.0D / {size} v", "1L _w", f"{size}L _n", "0.03D _h", "0D _mn", "1D _mx")
        n[size] = dist._box_moments(rows, [], "v").count()
    assert n[20000] <= 1 / (0.03 * 2 * dist.HALF_WIDTH) + 1 and n[20000] <= n[2000] * 1.01 + 1


@pytest.mark.parametrize("rows", [[], [("a", 1.0)], [("a", 1.0), ("a", 1.0)], [("a", None), (None, 2.0)]])
def test_no_density(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    assert kde(df, "v", ["g"]).count() == 0
