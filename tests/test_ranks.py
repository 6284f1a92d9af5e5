"""Ranks from explicit cut points: right under any partitioning, with and
without exchange reuse, and without a checkpoint."""

import numpy as np
import pandas as pd
import pytest

from zonestats.operators.dims import add_serial, dim_build
from zonestats.operators.order_stats import range_parts, ranked, weighted_positions


@pytest.fixture(params=[(16, "true"), (16, "false"), (400, "true"), (400, "false")], ids=str)
def parts(request, spark, monkeypatch):
    n, reuse = request.param
    old = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    from pyspark.sql import DataFrame
    refuse = lambda *a, **k: pytest.fail("checkpoint")
    monkeypatch.setattr(DataFrame, "checkpoint", refuse)
    monkeypatch.setattr(DataFrame, "localCheckpoint", refuse)
    yield n
    spark.conf.set("spark.sql.exchange.reuse", old)


def _hot(n=4000):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 40, n)
    g[: n // 3] = 7
    return pd.DataFrame({"g": g, "v": np.arange(n) * 0.5, "extra": [f"x{i % 11}" for i in range(n)], "_part": 1})


def test_ranks_are_a_permutation_of_each_group(spark, parts):
    pdf = _hot().drop(columns="_part").assign(_w=1)
    rows = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(7)
    got = ranked(rows, ["g"], ["v"], parts).toPandas()
    assert len(got) == len(pdf)
    for _, one in got.groupby("g"):
        one = one.sort_values("v")
        assert list(one["_before"]) == list(range(len(one))) and set(one["_n"]) == {len(one)}
    assert got.set_index("v")["extra"].to_dict() == pdf.set_index("v")["extra"].to_dict()


def test_serial_numbers_with_missing_values_and_copies(spark, parts, monkeypatch):
    monkeypatch.setattr("zonestats.operators.dims.COPIES", 64)
    rows = [(None, "a")] * 3 + [("k", None)] * 500 + [(f"n{i:03d}", None if i % 5 else "z") for i in range(300)]
    df = spark.createDataFrame(rows, "name string, other string").repartition(6)
    got = sorted(add_serial(df, "id", ["name"], parts).collect(), key=lambda r: r["id"])
    assert [r["id"] for r in got] == list(range(1, len(rows) + 1))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or ""))
    assert [(r["name"], r["other"]) for r in got] == want


def test_a_hot_group_is_cut_into_even_parts(spark):
    n = 64
    pdf = _hot(20000)[["g", "v"]]
    size = range_parts(spark.createDataFrame(pdf), ["g", "v"], n).groupBy("_part").count().toPandas().set_index("_part")["count"]
    assert size.sum() == len(pdf) and set(size.index) <= set(range(n))
    assert size.max() <= 2 * len(pdf) / n


def test_parts_follow_the_order_whatever_the_layout(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.0,), (5.0,), (9.0,)], "v double")
    first = {r["v"]: r["p"] for r in range_parts(df, ["v"], 4, "p").collect() if r["v"] == r["v"]}
    again = {r["v"]: r["p"] for r in range_parts(df.repartition(5), ["v"], 4, "p").collect() if r["v"] == r["v"]}
    assert first == again
    assert [first[v] for v in (-1.0, 0.0, 5.0, 9.0)] == sorted(first[v] for v in (-1.0, 0.0, 5.0, 9.0))
    assert first[None] >= first[9.0]


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert weighted_positions(none, ["g"], "v").count() == 0
    assert add_serial(none, "id").count() == 0 and dim_build(none, ["g"], "id").count() == 0
