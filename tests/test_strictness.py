"""Bad input raises or becomes missing, never a wrong value."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from zonestats.functions.columns import strict_int
from zonestats.operators.clean import float_to_int
from zonestats.operators.dims import apply_overrides
from zonestats.operators.dist import kde
from zonestats.operators.order_stats import exact_median
from zonestats.operators.rank import rank_by, share_of_total
from zonestats.sources.files import is_number, read_csv, read_preamble_csv


def _file(text):
    p = os.path.join(tempfile.mkdtemp(prefix="zs-strict-"), "t.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_strict_int_keeps_large_integers(spark):
    df = spark.createDataFrame([(9007199254740993, "9007199254740993", 2.0)], "a bigint, b string, c double")
    r = df.select(strict_int("a", "bigint").alias("a"), strict_int("b", "bigint").alias("b"), strict_int("c").alias("c")).first()
    assert tuple(r) == (9007199254740993, 9007199254740993, 2)
    with pytest.raises(Exception, match="whole number"):
        spark.createDataFrame([(2.7,)], "c double").select(strict_int("c")).collect()


def test_float_ids_with_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r["x"] for r in float_to_int(df).collect()] == [1, None, None]


def test_csv_header_order_is_checked(spark):
    with pytest.raises(Exception):
        read_csv(spark, _file("b,a\n1,2\n"), "a int, b int").collect()


def test_preamble_data_rows_are_strict(spark):
    p = _file("title,,\ncode,name,total\n5001,A,5x\nNote,,\n")
    with pytest.raises(Exception):
        read_preamble_csv(spark, p, "code string, name string, total int", is_number("code")).collect()


def test_overrides(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    fixes = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    assert {r["k"]: r["v"] for r in apply_overrides(df, fixes, "k", "v").collect()} == {1: None, 2: "x", 3: "c"}
    with pytest.raises(Exception, match="two fixes"):
        apply_overrides(df, fixes.union(fixes), "k", "v").collect()


def test_one_value_group_has_no_density(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0)], "g string, v double")
    assert {r["g"] for r in kde(df, "v", keys=["g"]).select("g").distinct().collect()} == {"a"}


def test_sums_do_not_overflow(spark):
    big = 9.0e16
    df = spark.createDataFrame([("a", big)] * 200, "g string, v double")
    assert rank_by(df, ["g"], "v", "sum", out="s", scale=1).first()["s"] == big * 200
    assert share_of_total(df, ["g"], "v", scale=1).first()["share_pct"] == 100.0


def test_scale_that_would_change_values_raises(spark):
    df = spark.createDataFrame([("a", 1.234)], "g string, v double")
    with pytest.raises(Exception, match="more than 2 decimals"):
        rank_by(df, ["g"], "v", "avg", scale=2).collect()


def test_scale_check_is_relative(spark):
    """A few roundings pass at any size; a further decimal does not."""
    with pytest.raises(Exception, match="more than 2 decimals"):
        rank_by(spark.createDataFrame([("a", 1.000004)], "g string, v double"), ["g"], "v", "sum", scale=2).collect()
    large = spark.createDataFrame([("a", 9999999999.9999), ("a", -0.0001)], "g string, v double")
    assert rank_by(large, ["g"], "v", "sum", out="s", scale=4).first()["s"] == 9999999999.9998
    product = spark.createDataFrame([(a / 100, b / 100) for a in range(100_000, 100_500) for b in range(9)], "a double, b double")
    product.selectExpr("'g' AS g", "a * b AS v").transform(lambda d: rank_by(d, ["g"], "v", "sum", scale=4)).collect()


def test_sums_of_more_rows_than_two_limbs_hold(spark):
    """2.3e9 rows of the largest 32-bit value, as 2,300 collapsed values of
    1e6 rows each and as weights of one; then values of all sizes and signs."""
    from zonestats.operators.rank import exact_sum, exact_units
    rows = spark.range(2300).selectExpr("42949672.95D AS v", "1000000L AS w")
    assert rows.agg(exact_units("v", 2, "w").alias("s")).first()["s"] == 4294967295 * 2300 * 1000000
    mixed = [(9.0e16, 200), (-9.0e16, 199), (0.5, 10**12), (-0.5, 7), (0.0, 5)]
    df = spark.createDataFrame(mixed, "v double, w long")
    assert df.agg(exact_units("v", 1, "w").alias("s")).first()["s"] == sum(int(v * 10) * w for v, w in mixed)
    assert df.agg(exact_sum("v", 1).alias("s")).first()["s"] == 0.0


def test_weighted_mean_of_large_values(spark):
    from zonestats.operators.stats import centre_stats
    df = spark.createDataFrame([(9.0e16,)] * 200, "v double")
    assert tuple(centre_stats(df, "v", scale=1).first()) == (9.0e16, 9.0e16, 9.0e16)


def test_range_partitions_follow_the_setting(spark):
    from zonestats.operators.order_stats import _num_partitions
    df = spark.range(10).select((F.col("id") * 1.0).alias("v"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        assert _num_partitions(df, None) == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert exact_median(df, "v", [], name="m").first()["m"] == 4.5
