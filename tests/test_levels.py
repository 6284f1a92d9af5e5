"""Several levels of a hierarchy, and several map measures, in one scan."""

import statistics

import pytest
from pyspark.sql import functions as F

from zonestats.operators.geo import map_aggregate, map_centre, map_measures, map_view_point
from zonestats.operators.rank import rank_by, rank_levels

LEVELS = [["d"], ["d", "m"], ["d", "m", "t"]]


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for i in range(600):
        d, m, t = f"d{i % 3}", f"m{i % 7}", f"t{i % 31}"
        out.append((None if i % 53 == 0 else d, None if i % 41 == 0 else m, None if i % 37 == 0 else t, i % 31,
                    None if i % 5 == 0 or i % 31 == 4 else (i % 97) / 4, float(i % 31 // 2), float(i % 31 % 3)))
    return spark.createDataFrame(out, "d string, m string, t string, id long, v double, lat double, lon double").cache()


@pytest.mark.parametrize("fn,extra", [
    ("avg", {"scale": 2}), ("avg", {}), ("sum", {"scale": 2}), ("sum", {}), ("count", {}), ("min", {}), ("max", {}),
    ("nunique", {}), ("sum", {"scale": 2, "dedupe_on": ["id"]}), ("nunique", {"dedupe_on": ["id"]})], ids=str)
def test_levels_equal_the_single_rankings(rows, fn, extra):
    got = rank_levels(rows, LEVELS, "v", fn, out="x", **extra).collect()
    for i, keys in enumerate(LEVELS):
        one = [tuple(r[c] for c in [*keys, "x"]) for r in got if r["level"] == i + 1]
        want = [tuple(r) for r in rank_by(rows, keys, "v", fn, out="x", **extra).collect()]
        if fn in ("avg", "sum") and not extra:
            assert {r[:-1] for r in one} == {r[:-1] for r in want}
            assert {r[:-1]: pytest.approx(r[-1]) for r in one} == {r[:-1]: r[-1] for r in want}
        else:
            assert one == want
        assert all(r[c] is None for r in got if r["level"] == i + 1 for c in LEVELS[2] if c not in keys)


def test_distinct_values_of_a_key_and_other_level_orders(rows):
    got = rank_levels(rows, [["m"], ["d", "t"]], "t", "nunique", out="n").collect()
    for i, keys in enumerate((["m"], ["d", "t"])):
        want = rank_by(rows, keys, "t", "nunique", out="n").collect()
        assert [tuple(r[c] for c in [*keys, "n"]) for r in got if r["level"] == i + 1] == [tuple(r) for r in want]
    with pytest.raises(ValueError):
        rank_levels(rows, [["d", "m"], ["m", "d"]], "v")
    with pytest.raises(ValueError):
        rank_levels(rows, LEVELS, "v", "median")


def test_levels_read_the_input_once(spark, tmp_path, rows):
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    plan = rank_levels(spark.read.parquet(path), LEVELS, "v", "avg", scale=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    # the expansion comes after the aggregate of the rows
    assert plan.index("Expand") < plan.rindex("HashAggregate") < plan.index("FileScan")


def test_map_measures_equal_the_single_maps(rows):
    both = rows.withColumn("w", F.when(F.col("id") % 4 > 0, F.col("v") * 2 + 1))
    got = map_measures(both, ["t"], ["v", "w"], "lat", "lon").collect()
    for m in ("v", "w"):
        want = sorted(map(tuple, map_aggregate(both, ["t"], m, "lat", "lon").select("t", "lat", "lon", m, "elevation_norm").collect()))
        assert sorted((r["t"], r["lat"], r["lon"], r["value"], r["elevation_norm"]) for r in got if r["measure"] == m) == want
        assert tuple(map_view_point(both, ["t"], m, "lat", "lon").first()) == pytest.approx(
            tuple(map_centre(map_aggregate(both, ["t"], m, "lat", "lon")).first()))


def test_map_measures_of_nothing(rows):
    assert map_measures(rows.limit(0), ["t"], ["v"], "lat", "lon").count() == 0
    assert tuple(map_view_point(rows.limit(0), ["t"], "v", "lat", "lon").first()) == (None, None)


def test_maps_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(0, 1000, 1, 4).selectExpr("cast(id % 50 as string) AS t", "IF(id % 7 = 0, NULL, cast(id % 90 as double)) AS v",
                                                 "cast(id % 50 as double) AS lat", "cast(-(id % 50) as double) AS lon")
    counted = rows.mapInArrow(count, rows.schema)
    got = map_aggregate(counted, ["t"], "v", "lat", "lon").collect()
    assert len(got) == 50 and seen.value == 1000
    want = map_aggregate(rows.coalesce(1), ["t"], "v", "lat", "lon").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    seen.value = 0
    assert map_measures(counted, ["t"], ["v"], "lat", "lon").count() == 50 and seen.value == 1000


MEASURES = [f"m{i}" for i in range(7)]


def _measured(spark, n=2000):
    """Place p0 holds a third of the rows; values and coordinates are missing now and then."""
    return spark.range(0, n, 1, 4).selectExpr(
        "IF(id % 3 = 0, 'p0', IF(id % 101 = 1, NULL, concat('p', id % 40))) AS t",
        *[f"IF(id % {i + 7} = 0 OR id % 40 = {i + 1}, NULL, (id * {i + 37}) % 1999 / 8 - 60) AS m{i}" for i in range(7)],
        "IF(id % 13 = 0, NULL, cast(id % 5 as double)) AS lat", "cast(-(id % 40) as double) AS lon")


def _shuffled_records(df):
    """Records written by the exchanges of a collected frame's final plan."""
    def walk(p):
        kind = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else \
            [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(map(walk, inner))
    return walk(df._jdf.queryExecution().executedPlan())


def test_map_measures_move_rows_not_values(spark):
    """Before, every measure's value of every row was a row of its own in two exchanges."""
    got = map_measures(_measured(spark).drop("lat").selectExpr("*", "0.0D AS lat"), ["t"], MEASURES, "lat", "lon")
    assert len(got.collect()) > 100
    assert 2000 <= _shuffled_records(got) < 3 * 2000


def _plain_map(rows, m):
    places = {}
    for r in rows:
        if r["t"] is not None:
            places.setdefault(r["t"], []).append(r)
    kept = {}
    for t in sorted(places):
        v, lat, lon = ([r[c] for r in places[t] if r[c] is not None] for c in (m, "lat", "lon"))
        if v and lat and lon:
            kept.setdefault((sum(lat) / len(lat), sum(lon) / len(lon)), (t, statistics.median(v)))
    top = max(v for _, v in kept.values())
    return sorted((t, *at, v, v / top * 10000.0) for at, (t, v) in kept.items())


@pytest.mark.parametrize("place_rows", [0, 60], ids=str)
def test_map_measures_rank_large_places_by_parts(spark, place_rows):
    """All places, or one, are too large for one array a measure."""
    rows = _measured(spark)
    got = {}
    for r in map_measures(rows, ["t"], MEASURES, "lat", "lon", place_rows=place_rows).collect():
        got.setdefault(r["measure"], []).append((r["t"], r["lat"], r["lon"], r["value"], r["elevation_norm"]))
    rows = rows.collect()
    for m in MEASURES:
        assert sorted(got[m]) == _plain_map(rows, m) and len(got[m]) > 20


def test_map_measures_read_their_input_once_with_large_places(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = _measured(spark)
    got = map_measures(rows.mapInArrow(count, rows.schema), ["t"], MEASURES, "lat", "lon", place_rows=60).collect()
    assert len(got) > 100 and seen.value == 2000


def test_map_measures_of_odd_values(spark):
    rows = spark.createDataFrame(
        [("a", -0.0, 1.0, 0.0), ("b", float("nan"), 2.0, 0.0), ("b", 3.0, 2.0, 0.0), ("b", 1.0, 2.0, 0.0),
         ("c", float("inf"), 3.0, 0.0), ("d", None, 4.0, 0.0), ("e", 5.0, None, 0.0)], "t string, v double, lat double, lon double")
    for place_rows in (0, 100):
        got = map_measures(rows, ["t"], ["v"], "lat", "lon", place_rows=place_rows).collect()
        assert sorted((r["t"], str(r["value"])) for r in got) == [("a", "0.0"), ("b", "3.0"), ("c", "inf")]
