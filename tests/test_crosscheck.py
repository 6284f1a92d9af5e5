"""Cross-checks against pandas/numpy (the reference's own libraries) on
seeded random frames, plus a skewed layout with one hot group."""

import math

import numpy as np
import pandas as pd
import pytest

from zonestats.operators.dist import frequency_table, kde
from zonestats.operators.order_stats import exact_quantiles
from zonestats.operators.stats import (
    box_stats,
    centre_stats,
    mode_all,
    position_stats,
    shape_stats,
    spread_stats,
)


def _frame(spark, seed=7, groups=12, hot_share=0.0, n=3000):
    rng = np.random.default_rng(seed)
    g = rng.integers(1, groups + 1, n)
    if hot_share:
        g[: int(n * hot_share)] = 0  # one group holds this share of all rows
    v = np.round(rng.gamma(2.0, 30.0, n), 2)
    pdf = pd.DataFrame({"g": g.astype("int64"), "v": v})
    return spark.createDataFrame(pdf).repartition(7), pdf


@pytest.mark.parametrize("hot", [0.0, 1 / 3])
def test_quartiles_and_median_bitwise(spark, hot):
    df, pdf = _frame(spark, hot_share=hot)
    got = exact_quantiles(df, "v", [0.25, 0.5, 0.75], ["g"], names=["q1", "q2", "q3"],
                          median_name="med", num_partitions=6).toPandas().set_index("g").sort_index()
    for g, s in pdf.groupby("g")["v"]:
        row = got.loc[g]
        assert row["q1"] == s.quantile(0.25) and row["q2"] == s.quantile(0.5)
        assert row["q3"] == s.quantile(0.75) and row["med"] == s.median()


def test_global_quantiles_bitwise(spark):
    df, pdf = _frame(spark)
    got = exact_quantiles(df, "v", [0.25, 0.75], names=["q1", "q3"], median_name="med").first()
    assert got["q1"] == pdf.v.quantile(0.25) and got["q3"] == pdf.v.quantile(0.75)
    assert got["med"] == pdf.v.median()


@pytest.mark.parametrize("hot", [0.0, 1 / 3])
def test_spread_shape_centre_vs_pandas(spark, hot):
    df, pdf = _frame(spark, hot_share=hot)
    sp = spread_stats(df, "v", ["g"], scale=2).toPandas().set_index("g")
    sh = shape_stats(df, "v", ["g"]).toPandas().set_index("g")
    for g, s in pdf.groupby("g")["v"]:
        std2 = round(s.std(), 2)
        assert sp.loc[g, "min"] == s.min() and sp.loc[g, "max"] == s.max()
        assert math.isclose(sp.loc[g, "variance"], s.var(), rel_tol=1e-12)
        assert sp.loc[g, "std"] == std2
        assert sp.loc[g, "cv"] == round((std2 / s.mean()) * 100, 2)
        assert math.isclose(sh.loc[g, "skewness"], s.skew(), rel_tol=1e-9)
        assert math.isclose(sh.loc[g, "kurtosis"], s.kurt(), rel_tol=1e-9)
    modes = mode_all(df, "v", ["g"]).toPandas()
    for g, s in pdf.groupby("g")["v"]:
        assert sorted(modes[modes.g == g]["mode"]) == sorted(s.mode().tolist())
    c = centre_stats(df, "v", ["g"], scale=2).toPandas()
    for g, s in pdf.groupby("g")["v"]:
        sub = c[c.g == g]
        assert math.isclose(sub["mean"].iloc[0], s.mean(), rel_tol=1e-13)
        assert sub["median"].iloc[0] == s.median()


@pytest.mark.parametrize("hot", [0.0, 1 / 3])
def test_box_whiskers(spark, hot):
    df, pdf = _frame(spark, hot_share=hot)
    b = box_stats(df, "v", ["g"]).toPandas().set_index("g")
    p = position_stats(df, "v", ["g"]).toPandas().set_index("g")
    for g, s in pdf.groupby("g")["v"]:
        lo, hi = p.loc[g, "lower_fence"], p.loc[g, "upper_fence"]
        inside = s[(s >= lo) & (s <= hi)]
        assert b.loc[g, "lower_whisker"] == inside.min()
        assert b.loc[g, "upper_whisker"] == inside.max()
        assert b.loc[g, "n_outliers"] == len(s) - len(inside)


@pytest.mark.parametrize("hot", [0.0, 1 / 3])
def test_frequency_table_vs_pd_cut(spark, hot):
    df, pdf = _frame(spark, hot_share=hot)
    ft = frequency_table(df, "v", ["g"]).toPandas()
    for g, s in pdf.groupby("g")["v"]:
        bins = int(math.log2(len(s) + 1))
        fa = pd.cut(s, bins=bins).value_counts().sort_index()
        mine = ft[ft.g == g].sort_values("class")
        assert list(mine["freq"]) == list(fa.values)
        assert list(mine["interval"]) == [str(i) for i in fa.index]
        fr = (fa / fa.sum()) * 100
        assert list(mine["rel_freq"]) == list(fr.values)
        assert list(mine["cum_rel_freq"]) == list(fr.cumsum().values)
        assert mine["cum_freq"].iloc[-1] == len(s)
        assert math.isclose(mine["cum_rel_freq"].iloc[-1], 100.0, rel_tol=1e-12)


def test_kde_vs_numpy(spark):
    df, pdf = _frame(spark, groups=3)
    k = kde(df, "v", ["g"]).toPandas()
    for g, s in pdf.groupby("g")["v"]:
        v = s.values
        h = 0.1 * v.std(ddof=1)
        grid = np.linspace(v.min(), v.max(), 1000)
        y = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
        mine = k[k.g == g].sort_values("point")
        assert (mine["x"].values == grid).all()
        assert np.allclose(mine["density"].values, y, rtol=1e-10, atol=0)
        # mass inside [min, max] is at most 1
        assert np.trapezoid(mine["density"].values, grid) <= 1.0 + 1e-9


def test_hot_value_pair_is_collapsed_and_exact(spark):
    """One (group, value) pair holds a third of all rows."""
    from zonestats.operators.order_stats import weighted_positions
    rng = np.random.default_rng(3)
    n = 6000
    g = rng.integers(0, 5, n)
    v = np.round(rng.uniform(0, 10, n), 1)
    g[: n // 3], v[: n // 3] = 2, 24.0
    pdf = pd.DataFrame({"g": g.astype("int64"), "v": v})
    df = spark.createDataFrame(pdf).repartition(5)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "37")  # many Arrow batches per partition: runs span batches
    try:
        pos = weighted_positions(df, ["g"], "v", num_partitions=3).toPandas()
    finally:
        spark.conf.set(key, old)
    assert len(pos) == len(pdf.drop_duplicates())
    for (gg, vv), row in pos.set_index(["g", "v"]).iterrows():
        grp = pdf[pdf.g == gg]
        assert row["_before"] == (grp.v < vv).sum() and row["_w"] == (grp.v == vv).sum()
        assert row["_n"] == len(grp)
    got = exact_quantiles(df, "v", [0.25, 0.75], ["g"], names=["q1", "q3"], median_name="med",
                          num_partitions=7).toPandas().set_index("g")
    for gg, s in pdf.groupby("g")["v"]:
        assert got.loc[gg, "q1"] == s.quantile(0.25) and got.loc[gg, "q3"] == s.quantile(0.75)
        assert got.loc[gg, "med"] == s.median()


def test_map_aggregate_vs_pandas(spark):
    from zonestats.operators.geo import map_aggregate
    rng = np.random.default_rng(11)
    n = 4000
    town = rng.integers(0, 60, n)
    lat = (town % 17).astype(float)       # shared locations across towns
    lon = (town % 5).astype(float)
    val = np.round(rng.uniform(0, 24, n), 1)
    val[rng.random(n) < 0.1] = np.nan      # missing measures
    pdf = pd.DataFrame({"town": [f"T{t:03d}" for t in town], "lat": lat, "lon": lon, "v": val})
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                "town string, lat double, lon double, v double")
    got = map_aggregate(sdf, ["town"], "v", "lat", "lon").toPandas().set_index("town").sort_index()
    g = pdf.groupby("town")
    ref = pd.DataFrame({"v": g["v"].median(), "lat": g["lat"].mean(), "lon": g["lon"].mean()})
    ref = ref.dropna(subset=["lat", "lon", "v"]).drop_duplicates(subset=["lat", "lon"])
    ref["elevation_norm"] = ref["v"] / ref["v"].max() * 10000
    assert list(got.index) == list(ref.index)
    for c in ["v", "lat", "lon", "elevation_norm"]:
        assert (got[c].values == ref[c].values).all(), c


def test_quantiles_without_exchange_reuse(spark):
    """Offsets and rows agree with exchange reuse off too: the parts are a
    function of the data."""
    df, pdf = _frame(spark, hot_share=1 / 3)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = exact_quantiles(df, "v", [0.25, 0.75], ["g"], names=["q1", "q3"],
                              num_partitions=5).toPandas().set_index("g")
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    for g, s in pdf.groupby("g")["v"]:
        assert got.loc[g, "q1"] == s.quantile(0.25) and got.loc[g, "q3"] == s.quantile(0.75)


def test_global_statistics_vs_pandas(spark):
    df, pdf = _frame(spark)
    s = pdf["v"]
    b = box_stats(df, "v").first()
    p = position_stats(df, "v").first()
    lo, hi = p["lower_fence"], p["upper_fence"]
    inside = s[(s >= lo) & (s <= hi)]
    assert (b["q1"], b["median"], b["q3"]) == (s.quantile(0.25), s.quantile(0.5), s.quantile(0.75))
    assert b["lower_whisker"] == inside.min() and b["upper_whisker"] == inside.max()
    assert b["n_outliers"] == len(s) - len(inside)
    sp = spread_stats(df, "v", scale=2).first()
    assert sp["min"] == s.min() and sp["max"] == s.max() and sp["std"] == round(s.std(), 2)
    assert math.isclose(sp["variance"], s.var(), rel_tol=1e-12)
    c = centre_stats(df, "v", scale=2).toPandas()
    assert sorted(c["mode"]) == sorted(s.mode().tolist()) and c["median"].iloc[0] == s.median()


def test_single_series_sorted_by_time(spark):
    import datetime as dt
    from zonestats.operators.lookup import time_series
    rows = [(1, dt.datetime(2025, 5, 23), 3.0), (2, dt.datetime(2025, 5, 21), 1.0),
            (1, dt.datetime(2025, 5, 21), 2.0), (1, dt.datetime(2025, 5, 22), 5.0)]
    df = spark.createDataFrame(rows, "town long, ts timestamp_ntz, v double")
    got = [(r["ts"].day, r["v"]) for r in time_series(df, "ts", ["v"], key="town", key_value=1).collect()]
    assert got == [(21, 2.0), (22, 5.0), (23, 3.0)]


def test_exact_sum_beyond_64_bits(spark):
    from zonestats.operators.rank import exact_sum
    df = spark.createDataFrame([(9.0e16,), (9.0e16,), (-1.0,)], "v double")
    assert df.agg(exact_sum("v", 2).alias("s")).first()["s"] == 1.8e17   # 1.8e19 units, beyond 2^63
    ok = spark.createDataFrame([(0.1,), (0.2,)], "v double").agg(exact_sum("v", 2).alias("s")).first()
    assert ok["s"] == 0.3
