"""Property tests on random frames (duplicates, missing values, one hot
group) against pandas, the reference's library."""

import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from zonestats.operators.dist import frequency_table
from zonestats.operators.order_stats import exact_quantiles
from zonestats.operators.stats import mode_all

ROWS = st.lists(
    st.tuples(st.sampled_from([1, 1, 1, 2, 3]),  # group 1 is hot
              st.one_of(st.none(), st.integers(-500, 500).map(lambda i: i / 4))),
    min_size=1, max_size=60)

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def _frames(spark, rows):
    pdf = pd.DataFrame(rows, columns=["g", "v"]).astype({"v": "float64"})
    return spark.createDataFrame(rows, "g long, v double").repartition(3), pdf


@SETTINGS
@given(rows=ROWS)
def test_quantiles_and_modes_match_pandas(spark, rows):
    df, pdf = _frames(spark, rows)
    q = exact_quantiles(df, "v", [0.25, 0.75], ["g"], names=["q1", "q3"], median_name="med",
                        num_partitions=4).toPandas().set_index("g")
    modes = mode_all(df, "v", ["g"]).toPandas()
    for g, s in pdf.groupby("g")["v"]:
        s = s.dropna()
        if s.empty:
            assert g not in q.index
            continue
        assert q.loc[g, "q1"] == s.quantile(0.25) and q.loc[g, "q3"] == s.quantile(0.75)
        assert q.loc[g, "med"] == s.median()
        assert sorted(modes[modes.g == g]["mode"]) == sorted(s.mode().tolist())


@SETTINGS
@given(rows=ROWS)
def test_frequency_table_matches_pd_cut(spark, rows):
    df, pdf = _frames(spark, rows)
    ft = frequency_table(df, "v", ["g"]).toPandas()
    for g, s in pdf.groupby("g")["v"]:
        bins = int(math.log2(len(s) + 1))  # all rows, missing included
        mine = ft[ft.g == g].sort_values("class")
        if s.dropna().empty:
            assert mine.empty
            continue
        fa = pd.cut(s, bins=bins).value_counts().sort_index()
        assert list(mine["freq"]) == list(fa.values)
        assert list(mine["interval"]) == [str(i) for i in fa.index]
        assert mine["cum_freq"].iloc[-1] == s.notna().sum()
