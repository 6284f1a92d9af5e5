"""Map aggregates: one column per location, scaled to the maximum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestats.operators.clean import distinct_first
from zonestats.operators.order_stats import exact_median

PLACE_ROWS = 50_000  # rows of a place whose values are sorted as one array
LARGE_PLACES = 10_000  # places ranked by parts instead, at most


def _sums(lat: str, lon: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("_w"),
            F.sum(lat).alias("_slat"), F.count(lat).alias("_nlat"),
            F.sum(lon).alias("_slon"), F.count(lon).alias("_nlon")]


def _whole() -> Column:
    return (F.col("_w") > 0) & (F.isnull("_slat") == (F.col("_nlat") == 0)) & (F.isnull("_slon") == (F.col("_nlon") == 0))


def _collapsed(src: DataFrame, group: Sequence[str], value: str, lat: str, lon: str) -> DataFrame:
    """(group, value) rows with counts and coordinate sums. The filter holds for
    every row, but needs every aggregate, and so does the value: whatever reads
    these rows reads the same exchange, with no column or filter pushed below it."""
    c = src.groupBy(*group, value).agg(*_sums(lat, lon))
    return c.where(_whole()).withColumn(value, F.when(F.col("_w") > 0, F.col(value)))


def map_aggregate(df: DataFrame, keys: Sequence[str], measure: str, lat: str, lon: str,
                  scale: float = 10000.0, out: str = "elevation_norm",
                  num_partitions: int | None = None) -> DataFrame:
    """Per place (``keys``): exact median of ``measure``, mean latitude and
    longitude; places missing any of the three are dropped; places sharing
    the same (lat, lon) keep the first by key; ``out`` = measure / max * scale.

    The input is read once: it is collapsed to (place, value) rows with
    counts and coordinate sums, from which come both the skew-safe exact
    median and the mean position; the maximum is a scalar subquery over whole
    map rows, which shares their exchange (no join, no global window).
    """
    keys = list(keys)
    src = df.select(*keys, measure, lat, lon)
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    c = _collapsed(src, keys, measure, lat, lon)
    med = exact_median(c, measure, keys, name=measure, num_partitions=num_partitions, weight="_w")
    pos = c.groupBy(*keys).agg((F.sum("_slat") / F.sum("_nlat")).alias("lat"),
                               (F.sum("_slon") / F.sum("_nlon")).alias("lon"))
    m = pos.join(med, keys, "left")
    m = m.dropna(how="any", subset=["lat", "lon", measure])
    m = distinct_first(m, ["lat", "lon"], keys)
    top = m.select(F.max(F.struct(measure, *[x for x in m.columns if x != measure])).getField(measure)).scalar()
    return m.withColumn(out, F.col(measure) / F.nullif(top, F.lit(0.0)) * F.lit(scale))


def map_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str], lat: str, lon: str,
                 scale: float = 10000.0, out: str = "elevation_norm", num_partitions: int | None = None,
                 place_rows: int = PLACE_ROWS) -> DataFrame:
    """``map_aggregate`` of several measures with one read of the input: rows
    (``measure``, keys, ``lat``, ``lon``, ``value``, ``out``), each measure as
    its own map (its own missing places, shared locations and maximum).

    The rows are dealt evenly once, all measures side by side; every step reads
    that exchange. A place of at most ``place_rows`` rows (or a ``LARGE_PLACES``-th
    of all rows, if that is more) has its values sorted as one array a measure.
    Larger places, ``LARGE_PLACES`` at most, are ranked by parts instead
    (``exact_median``), so no place is one task's work, however large."""
    keys = list(keys)
    group, values = ["measure", *keys], [f"_v{i}" for i in range(len(measures))]
    src = df.select(*keys, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"),
                    *[F.col(m).cast("double").alias(v) for m, v in zip(measures, values)])
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    # the deal needs every column, so no reader prunes the exchange; equal rows of several tasks part
    rows = src.withColumn("_from", F.spark_partition_id())
    rows = rows.repartition(*rows.columns)

    by_measure = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(v).alias("value"))
                                     for m, v in zip(measures, values)])).alias("_m")
    placed = rows.groupBy(*keys).agg(*_sums("_lat", "_lon")).where(_whole())  # one exchange, see _collapsed
    most = F.greatest(F.lit(float(place_rows)), placed.agg(F.sum("_w") / F.lit(float(LARGE_PLACES))).scalar())
    large = placed.where(F.col("_w") > most)  # fewer than LARGE_PLACES: a proven bound
    # not an anti join, which would be pushed below the exchange
    small = rows.join(F.broadcast(large.select(*keys, F.lit(True).alias("_large"))), keys, "left").where(F.isnull("_large"))
    lists = small.groupBy(*keys).agg(*_sums("_lat", "_lon"), *[F.sort_array(F.collect_list(v)).alias(v) for v in values])
    # without values both places are outside: missing; + 0.0, as -0.0 is grouped as 0.0
    middle = [((F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int")))
               / F.lit(2.0) + F.lit(0.0)).alias(v) for v in values]
    mean = [(F.col(f"_s{x}") / F.nullif(F.col(f"_n{x}"), F.lit(0))).alias(x) for x in ("lat", "lon")]
    few = lists.select(*keys, *mean, *middle).select(*keys, "lat", "lon", by_measure) \
        .select("_m.measure", *keys, "lat", "lon", "_m.value")
    split = rows.join(F.broadcast(large.select(*keys)), keys).select(*keys, by_measure)
    med = exact_median(split.select("_m.measure", *keys, "_m.value"), "value", group, name="value", num_partitions=num_partitions)
    many = med.join(F.broadcast(large.select(*keys, *mean)), keys).select(*group, "lat", "lon", "value")
    m = few.unionByName(many).dropna(how="any", subset=["lat", "lon", "value"])
    m = distinct_first(m, ["measure", "lat", "lon"], keys)
    top = m.groupBy(F.col("measure").alias("_of")).agg(
        F.max(F.struct("value", "lat", "lon", *keys)).getField("value").alias("_top"))
    # one row a measure: a proven bound
    m = m.join(F.broadcast(top), F.col("measure") == F.col("_of"))
    return m.select(*group, "lat", "lon", "value", (F.col("value") / F.nullif("_top", F.lit(0.0)) * F.lit(scale)).alias(out))


def map_view_point(df: DataFrame, keys: Sequence[str], measure: str, lat: str, lon: str) -> DataFrame:
    """``map_centre`` of ``map_aggregate``'s rows without the medians: which
    places are on the map depends on whether they have a value, not on it."""
    keys = list(keys)
    places = df.groupBy(*keys).agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.count(measure).alias("_n"))
    for k in keys:
        places = places.where(F.col(k).isNotNull())
    return map_centre(places.where(F.col("_n") > 0).select("lat", "lon").dropna(how="any").distinct())


def map_centre(map_df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Initial view point: mean latitude and longitude of the map rows."""
    return map_df.agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))
