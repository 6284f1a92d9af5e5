"""Randomised stress tests (hypothesis) against pandas: random partition
counts and Arrow batch sizes, so group runs span partitions and batches."""

import math

import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st
from zonestats.operators.dist import frequency_table
from zonestats.operators.order_stats import exact_quantiles
from zonestats.operators.stats import box_stats, centre_stats, position_stats, shape_stats, spread_stats

ROWS = st.lists(st.tuples(st.sampled_from([1, 1, 1, 2, 3, 4]),
                          st.one_of(st.none(), st.integers(-50, 50).map(lambda i: i / 8))),
                min_size=1, max_size=120)
S = settings(max_examples=8, deadline=None,
             suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@S
@given(rows=ROWS, parts=st.integers(1, 6), batch=st.sampled_from(["3", "7", "10000"]))
def test_stress(spark, rows, parts, batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        _check(spark, rows, parts)
    finally:
        spark.conf.set(key, old)


def _check(spark, rows, parts):
    pdf = pd.DataFrame(rows, columns=["g", "v"]).astype({"v": "float64"})
    df = spark.createDataFrame(rows, "g long, v double").repartition(parts)
    q = exact_quantiles(df, "v", [0.1, 0.25, 0.75, 0.9], ["g"], names=["a", "b", "c", "d"],
                        median_name="m", num_partitions=parts).toPandas().set_index("g")
    c = centre_stats(df, "v", ["g"], scale=3, num_partitions=parts).toPandas()
    for g, s in pdf.groupby("g")["v"]:
        s = s.dropna()
        if s.empty:
            assert g not in q.index
            continue
        for name, p in zip("abcd", [0.1, 0.25, 0.75, 0.9]):
            assert q.loc[g, name] == s.quantile(p), (g, name)
        assert q.loc[g, "m"] == s.median()
        cc = c[c.g == g]
        assert sorted(cc["mode"]) == sorted(s.mode().tolist())
        assert cc["median"].iloc[0] == s.median()
        assert math.isclose(cc["mean"].iloc[0], s.mean(), rel_tol=1e-12, abs_tol=1e-12)
    ft = frequency_table(df, "v", ["g"]).toPandas()
    for g, s in pdf.groupby("g")["v"]:
        mine = ft[ft.g == g].sort_values("class")
        if s.dropna().empty:
            assert mine.empty
            continue
        fa = pd.cut(s, bins=int(math.log2(len(s) + 1))).value_counts().sort_index()
        assert list(mine["freq"]) == list(fa.values)
        assert list(mine["interval"]) == [str(i) for i in fa.index]


ROWS_BOX = st.lists(st.tuples(st.sampled_from([1, 1, 2, 3]),
                          st.one_of(st.none(), st.integers(-400, 400).map(lambda i: i / 4))),
                min_size=1, max_size=80)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(rows=ROWS_BOX, parts=st.integers(1, 5))
def test_stress_box(spark, rows, parts):
    pdf = pd.DataFrame(rows, columns=["g", "v"]).astype({"v": "float64"})
    df = spark.createDataFrame(rows, "g long, v double").repartition(parts)
    b = box_stats(df, "v", ["g"], num_partitions=parts).toPandas().set_index("g")
    p = position_stats(df, "v", ["g"], num_partitions=parts).toPandas().set_index("g")
    sp = spread_stats(df, "v", ["g"], scale=2).toPandas().set_index("g")
    sh = shape_stats(df, "v", ["g"]).toPandas().set_index("g")
    for g, s in pdf.groupby("g")["v"]:
        s = s.dropna()
        if s.empty:
            assert g not in b.index
            continue
        lo, hi = p.loc[g, "lower_fence"], p.loc[g, "upper_fence"]
        inside = s[(s >= lo) & (s <= hi)]
        assert b.loc[g, "q1"] == s.quantile(0.25) and b.loc[g, "q3"] == s.quantile(0.75)
        assert b.loc[g, "lower_whisker"] == inside.min() and b.loc[g, "upper_whisker"] == inside.max()
        assert b.loc[g, "n_outliers"] == len(s) - len(inside)
        assert sp.loc[g, "min"] == s.min() and sp.loc[g, "max"] == s.max()
        if len(s) > 1:
            assert math.isclose(sp.loc[g, "variance"], s.var(), rel_tol=1e-9, abs_tol=1e-9)
        sk, ku = s.skew(), s.kurt()
        for mine, ref in ((sh.loc[g, "skewness"], sk), (sh.loc[g, "kurtosis"], ku)):
            if ref is None or (isinstance(ref, float) and math.isnan(ref)):
                assert mine is None or (isinstance(mine, float) and math.isnan(mine))
            else:
                assert math.isclose(mine, ref, rel_tol=1e-7, abs_tol=1e-7), (g, mine, ref)
