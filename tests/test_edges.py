"""Edge cases the driver tables do not contain (FIXTURES.md §3), on inline rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from zonestats.functions.columns import power_factor, round_half_even
from zonestats.operators.clean import (
    distinct_first,
    nan_to_null_all,
    parse_timestamp,
    recode,
    strict_int_cast,
    float_to_int,
)
from zonestats.operators.dist import frequency_table, kde
from zonestats.operators.joins import join_null_safe
from zonestats.operators.lookup import lookup_id, lookup_ids
from zonestats.operators.quality import audit_keys, has_values, missing_keys
from zonestats.operators.rank import rank_by, share_of_total
from zonestats.operators.stats import centre_stats, shape_stats, spread_stats
from zonestats.operators.cluster import (
    RULE_HIGH_USE,
    RULE_LOW_POWER,
    RULE_MIXED,
    RULE_REACTIVE,
    RULE_VERY_LOW_PF,
    classify,
)
from zonestats.plans.star import REFERENCE_LABELS, star_view
from zonestats import schemas


def test_null_group_and_all_missing_sum(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), (None, 3.0)], "k string, v double")
    got = {r["k"]: r["v"] for r in rank_by(df, ["k"], "v", "sum").collect()}
    assert got == {"a": 0.0, "b": 1.0}


def test_nan_is_missing_after_ingest(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    r = nan_to_null_all(df).agg(F.avg("v").alias("m"), F.count("v").alias("n")).first()
    assert r["m"] == 1.0 and r["n"] == 1


def test_null_safe_join(spark):
    left = spark.createDataFrame([("a", None), ("b", "x")], "id string, cls string")
    dim = spark.createDataFrame([("x", 1), (None, 2)], "cls string, id_cls int")
    safe = join_null_safe(left, dim, ["cls"]).orderBy("id").collect()
    assert [(r["id"], r["id_cls"]) for r in safe] == [("a", 2), ("b", 1)]
    plain = left.join(dim, "cls", "left").where(F.col("id_cls").isNotNull()).count()
    assert plain == 1


def test_zero_energy_power_factor_is_null(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "a double, r double")
    got = [r[0] for r in df.select(power_factor("a", "r")).collect()]
    assert got[0] is None and got[1] == 0.6


def _domain(spark, census_rows, services_rows, towns_rows):
    deps = spark.createDataFrame([(1, "D1"), (2, "D2")], schemas.DEPARTMENTS)
    munis = spark.createDataFrame([(10, "SAN JOSE", 1, None, 1, None), (20, "SAN JOSE", 2, None, 1, None)],
                                  schemas.MUNICIPALITIES)
    towns = spark.createDataFrame(towns_rows, schemas.TOWNS)
    services = spark.createDataFrame(services_rows, schemas.SERVICES)
    census = spark.createDataFrame(census_rows, schemas.CENSUS)
    return star_view(services, towns, munis, deps, census, REFERENCE_LABELS)


TS = dt.datetime(2025, 5, 21, 19, 30)


def test_duplicate_census_doubles_rows_and_orphan_fact_kept(spark):
    towns = [(100, "T1", 10, -70.0, 5.0, 1), (200, "T2", 20, -71.0, 6.0, 1)]
    services = [(1, 100, 10.0, 0.0, 5.0, TS, 24.0), (2, 999, 7.0, 1.0, 2.0, TS, 12.0)]
    census = [(1, 100, 50.0, 0.0, 0.0, 30.0, 0.0, 0.0, 0.0, 40),
              (2, 100, 55.0, 0.0, 0.0, 35.0, 0.0, 0.0, 0.0, 42)]
    v = _domain(spark, census, services, towns)
    assert len(v.columns) == 17
    rows = v.collect()
    assert len(rows) == 3  # service 1 twice (two census rows), orphan once
    orphan = [r for r in rows if r["Energía Activa [kWh]"] == 7.0][0]
    assert orphan["Código Centro Poblado"] is None and orphan["Departamento"] is None
    cen = spark.createDataFrame(census, schemas.CENSUS)
    dup = audit_keys(cen, ["id_centro_poblado"]).collect()
    assert [(r["check"], r["key"], r["n"]) for r in dup] == [("duplicate_pk", "100", 2)]
    fact = spark.createDataFrame(services, schemas.SERVICES)
    places = spark.createDataFrame(towns, schemas.TOWNS)
    miss = missing_keys(fact, places, "id_centro_poblado").collect()
    assert [r[0] for r in miss] == [999]


def test_homonyms(spark):
    towns = [(100, "T1", 10, -70.0, 5.0, 1), (200, "T2", 20, -71.0, 6.0, 1)]
    services = [(1, 100, 10.0, 0.0, 5.0, TS, 24.0), (2, 200, 30.0, 0.0, 2.0, TS, 12.0)]
    v = _domain(spark, [], services, towns)
    L = REFERENCE_LABELS
    assert lookup_id(v, L.muni_id, L.muni_name, "SAN JOSE").first()[0] == 10
    assert lookup_id(v, L.muni_id, L.muni_name, "SAN JOSE", scope={L.dept_id: 2}).first()[0] == 20
    ids = lookup_ids(v, L.muni_id, L.muni_name).first()
    assert ids["n_codes"] == 2
    ranked = rank_by(v, [L.dept_name, L.muni_name], L.active, "sum").collect()
    assert len(ranked) == 2  # keyed by department too: kept apart
    pie = share_of_total(v, [L.muni_name], L.active).collect()
    assert len(pie) == 1 and pie[0]["share_pct"] == 100.0  # label shares add up


def test_constant_and_short_series(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "v double")
    sp = spread_stats(df, "v").first()
    assert sp["variance"] == 0.0 and sp["std"] == 0.0
    sh = shape_stats(df, "v").first()
    assert sh["skewness"] == 0.0 and sh["kurtosis"] is None
    ft = frequency_table(df, "v", bins=2).orderBy("class").collect()
    assert [(r["lower"], r["upper"], r["freq"]) for r in ft] == [(4.995, 5.0, 3), (5.0, 5.005, 0)]
    assert kde(df, "v").count() == 0
    for n, var_null, skew_null, kurt_null in [(1, True, True, True), (2, False, True, True),
                                              (3, False, False, True)]:
        d = spark.createDataFrame([(float(i * i + 1),) for i in range(n)], "v double")
        assert (spread_stats(d, "v").first()["variance"] is None) == var_null
        s = shape_stats(d, "v").first()
        assert (s["skewness"] is None) == skew_null and (s["kurtosis"] is None) == kurt_null


def test_constant_zero_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,)], "v double")
    ft = frequency_table(df, "v", bins=2).orderBy("class").collect()
    assert [(r["lower"], r["upper"], r["freq"]) for r in ft] == [(-0.001, 0.0, 3), (0.0, 0.001, 0)]


def test_two_modes(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,), (3.0,)], "v double")
    rows = centre_stats(df, "v").orderBy("mode").collect()
    assert [(r["mode"], r["mean"], r["median"]) for r in rows] == [(1.0, 1.8, 2.0), (2.0, 1.8, 2.0)]


def test_empty_class_kept(spark):
    vals = [1.0, 1.1, 1.2, 9.8, 9.9, 10.0, 1.05]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    ft = frequency_table(df, "v").orderBy("class").collect()
    assert len(ft) == 3 and ft[1]["freq"] == 0 and ft[1]["cum_freq"] == ft[0]["cum_freq"]


def test_empty_input(spark):
    df = spark.createDataFrame([], "k long, v double, lat double, lon double")
    assert spread_stats(df, "v", ["k"]).count() == 0
    assert centre_stats(df, "v", ["k"]).count() == 0
    assert frequency_table(df, "v").count() == 0
    assert has_values(df, ["lat", "lon"]).first()[0] is False


def test_time_text(spark):
    df = spark.createDataFrame([("05/21/2025 07:30:00 PM",), ("5/2/2025 7:30:00 PM",)], "t string")
    got = [r[0] for r in parse_timestamp(df, "t").collect()]
    assert got == [dt.datetime(2025, 5, 21, 19, 30), dt.datetime(2025, 5, 2, 19, 30)]
    bad = spark.createDataFrame([("x",)], "t string")
    assert parse_timestamp(bad, "t", strict=False).first()[0] is None
    with pytest.raises(Exception):
        parse_timestamp(bad, "t").collect()


def test_fraction_guard(spark):
    ok = spark.createDataFrame([(2.0,)], "v double")
    assert float_to_int(ok).first()[0] == 2
    bad = spark.createDataFrame([(2.7,)], "v double")
    with pytest.raises(Exception):
        strict_int_cast(bad, ["v"]).collect()


def test_recode_others_missing(spark):
    # Fixed value: the census class recode of the cleaning job.
    df = spark.createDataFrame([("Rural Disperso",), ("Otro",), (None,)], "c string")
    got = [r[0] for r in recode(df, "c", {"Rural Disperso": 3}, value_type="int").collect()]
    assert got == [3, None, None]


def test_rule_rows_first_match(spark):
    rows = [(60000.0, 0.0, 100.0, 0.80), (1.0, 0.0, 50.0, 0.96), (1.0, 20000.0, 100.0, 0.9),
            (1.0, 0.0, 100.0, 0.7), (1.0, 0.0, 100.0, 0.9), (60000.0, 20000.0, 50.0, 0.5)]
    df = spark.createDataFrame(rows, "a double, r double, p double, f double")
    got = [r["description"] for r in classify(df, "a", "r", "p", "f").collect()]
    assert got == [RULE_HIGH_USE, RULE_LOW_POWER, RULE_REACTIVE, RULE_VERY_LOW_PF, RULE_MIXED,
                   RULE_HIGH_USE]


def test_half_round(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2.5,)], "v double")
    got = [r[0] for r in df.select(round_half_even("v", 2)).collect()]
    assert got == [0.12, 0.14, 2.5]


def test_same_place_first_by_key(spark):
    df = spark.createDataFrame([(2, "B", 1.0, 1.0), (1, "A", 1.0, 1.0), (3, "C", 2.0, 1.0)],
                               "id int, name string, lat double, lon double")
    got = sorted((r["lat"], r["id"]) for r in distinct_first(df, ["lat", "lon"], ["id"]).collect())
    assert got == [(1.0, 1), (2.0, 3)]


def test_nan_power_factor_range(spark):
    df = spark.createDataFrame([(3.0, -4.0), (-3.0, 4.0), (1e-300, 1e-300)], "a double, r double")
    for (v,) in df.select(power_factor("a", "r")).collect():
        assert v is None or (-1.0 <= v <= 1.0 and not math.isnan(v))


def test_labels_print_like_python(spark):
    from zonestats.functions.columns import float_text
    vals = [0.00021, -0.00016, 1.5e-05, 0.001, 41.907, 5.0, 12345678.0, 1e16]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(float_text("x")).collect()] == [repr(v) for v in vals]


def test_label_members_is_one_join(spark):
    from zonestats.operators.cluster import label_members
    members = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 2), (5, None)], "id int, cluster int")
    summary = spark.createDataFrame([(0, "a"), (1, "b"), (1, "a"), (2, "c")], "cluster int, description string")
    got = label_members(members, summary, "cluster")
    assert sorted((r["id"], r["description"]) for r in got.collect()) == [(1, "a"), (2, "a"), (3, "a"), (4, "c"), (5, None)]


def test_label_precision_grows_until_edges_differ(spark):
    import pandas as pd
    vals = [0.125, 0.125, 0.125]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r["interval"] for r in frequency_table(df, "v").orderBy("class").collect()]
    want = [str(i) for i in pd.cut(pd.Series(vals), bins=2).value_counts().sort_index().index]
    assert got == want


def test_profile_of_columns_with_odd_names(spark):
    from zonestats.operators.quality import profile_columns
    df = spark.createDataFrame([(1, None, 2.0), (2, "x", None)], "`a\tb` int, `c.d` string, `e``f` double")
    got = sorted(tuple(r) for r in profile_columns(df).collect())
    assert got == [(0, "a\tb", "int", 2), (1, "c.d", "string", 1), (2, "e`f", "double", 1)]


def test_series_rows_of_one_time_are_ordered(spark):
    from zonestats.operators.lookup import time_series
    df = spark.createDataFrame([(1, 5, 3.0), (1, 5, 1.0), (1, 4, 2.0), (2, 5, 0.0)], "town int, ts int, v double").repartition(3)
    assert [tuple(r) for r in time_series(df, "ts", ["v"], key="town", key_value=1).collect()] == [(4, 2.0), (5, 1.0), (5, 3.0)]
    assert [tuple(r) for r in time_series(df, "ts", ["v"], key="town").collect()] == [(1, 4, 2.0), (1, 5, 1.0), (1, 5, 3.0), (2, 5, 0.0)]
