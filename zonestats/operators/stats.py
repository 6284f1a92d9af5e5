"""Descriptive statistics of one measure, for every group at once.

The reference computes each statistic for one chosen town's series; here
each operator takes ``keys`` (e.g. the town key) and returns one row per
group (``keys=()`` gives the whole column). Moments come from one
``groupBy().agg`` with partial aggregation; quantiles from the exact,
skew-safe ``order_stats``; modes from a (group, value) count.

pandas conventions kept: sample variance/std (ddof 1), bias-corrected
skewness and excess kurtosis (0 for a constant column, NULL for fewer
than 3 / 4 values), linear-interpolated quartiles, all modes ascending,
std and cv rounded to 2 decimals with numpy's half-to-even rule, and cv
computed from the *rounded* std.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestats.functions.columns import round_half_even
from zonestats.operators.joins import join_salted
from zonestats.operators.order_stats import exact_quantiles


def _clean(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    src = df.select(*keys, value)
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    return src


def mean_expr(value: str, scale: int | None = None) -> Column:
    """Mean of the non-missing values; with ``scale`` the sum is exact
    (integer units, reproducible whatever the partitioning)."""
    if scale is None:
        return F.avg(value)
    from zonestats.operators.rank import exact_sum
    return exact_sum(value, scale) / F.count(value)


def _group(src: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return src.groupBy(*keys).agg(*aggs) if keys else src.agg(*aggs)


def collapse(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (keys, value) rows with their count ``_w``: a partial
    aggregate, so repeated values never travel more than once per task."""
    src = _clean(df, value, keys).where(F.col(value).isNotNull())
    return src.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))


def _modes(c: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    top = _group(c, keys, F.max("_w").alias("_top"))
    if keys:
        modes = join_salted(c, top, keys, value, ["_top"]).where(F.col("_w") == F.col("_top"))
    else:
        modes = c.where(F.col("_w") == top.select("_top").scalar())
    return modes.select(*keys, F.col(value).alias(out))


def mode_all(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "mode") -> DataFrame:
    """Every most frequent value per group (ties all kept), ascending."""
    keys = list(keys)
    return _modes(collapse(df, value, keys), value, keys, out).orderBy(*keys, out)


def _weighted_mean(value: str, scale: int | None) -> Column:
    """Mean over collapsed (value, _w) rows; exact with ``scale``."""
    if scale is None:
        return F.sum(F.col(value) * F.col("_w")) / F.sum("_w")
    from zonestats.operators.rank import exact_sum
    return exact_sum(value, scale, "_w") / F.sum("_w")


def centre_stats(df: DataFrame, value: str, keys: Sequence[str] = (), scale: int | None = None,
                 names: Sequence[str] = ("mean", "median", "mode"),
                 num_partitions: int | None = None) -> DataFrame:
    """Mean, median and mode; one row per mode with the scalars repeated.
    A group without values gives no row (as the reference's table).

    The input is read once: mean, median and modes all come from its
    collapse to (group, value, count)."""
    keys = list(keys)
    mean_n, median_n, mode_n = names
    c = collapse(df, value, keys)
    mean = _weighted_mean(value, scale).alias("_mean")
    med = exact_quantiles(c, value, [], keys, median_name="_median", num_partitions=num_partitions, weight="_w")
    scalars = [F.col("_mean").alias(mean_n), F.col("_median").alias(median_n), F.col(value).alias(mode_n)]
    if keys:
        per_group = _group(c, keys, F.max("_w").alias("_top"), mean).join(med, keys)
        modes = join_salted(c, per_group, keys, value, ["_top", "_mean", "_median"])
        return modes.where(F.col("_w") == F.col("_top")).select(*keys, *scalars).orderBy(*keys, mode_n)
    modes = _modes(c, value, keys, value)
    means = _group(c, keys, mean)
    return modes.withColumns({"_mean": means.select("_mean").scalar(), "_median": med.select("_median").scalar()}) \
                .select(*scalars).orderBy(mode_n)


def spread_stats(df: DataFrame, value: str, keys: Sequence[str] = (),
                 scale: int | None = None) -> DataFrame:
    """min, max, range, sample variance, std (2 decimals), cv % (2 decimals)."""
    keys = list(keys)
    src = _clean(df, value, keys)
    g = _group(
        src, keys,
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("_std"),
        mean_expr(value, scale).alias("_mean"),
    )
    std2 = round_half_even("_std", 2)
    return g.select(
        *keys, "min", "max", (F.col("max") - F.col("min")).alias("range"), "variance",
        std2.alias("std"),
        round_half_even(std2 / F.nullif(F.col("_mean"), F.lit(0.0)) * F.lit(100.0), 2).alias("cv"),
    )


def shape_stats(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bias-corrected skewness (G1) and excess kurtosis (G2), as pandas.

    Spark's ``skewness``/``kurtosis`` are the population g1/g2; they are
    converted with G1 = g1*sqrt(n(n-1))/(n-2) and
    G2 = (n-1)/((n-2)(n-3)) * ((n+1)*g2 + 6).
    """
    keys = list(keys)
    src = _clean(df, value, keys)
    g = _group(src, keys, F.count(value).alias("_n"), F.var_pop(value).alias("_m2"),
               F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2"))
    n = F.col("_n").cast("double")
    skew = (F.when(F.col("_n") < 3, F.lit(None).cast("double"))
             .when(F.col("_m2") == 0, F.lit(0.0))
             .otherwise(F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)))
    kurt = (F.when(F.col("_n") < 4, F.lit(None).cast("double"))
             .when(F.col("_m2") == 0, F.lit(0.0))
             .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)))
    return g.select(*keys, skew.alias("skewness"), kurt.alias("kurtosis"))


def position_stats(df: DataFrame, value: str, keys: Sequence[str] = (),
                   num_partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Q1, Q2, Q3, IQR and the 1.5 IQR fences. ``weight``: the input is
    already collapsed to distinct (keys, value) rows with this count."""
    keys = list(keys)
    src = df if weight else _clean(df, value, keys)
    q = exact_quantiles(src, value, [0.25, 0.5, 0.75], keys, names=["q1", "q2", "q3"],
                        num_partitions=num_partitions, weight=weight)
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, "q1", "q2", "q3", iqr.alias("iqr"),
                    (F.col("q1") - F.lit(1.5) * iqr).alias("lower_fence"),
                    (F.col("q3") + F.lit(1.5) * iqr).alias("upper_fence"))


def box_stats(df: DataFrame, value: str, keys: Sequence[str] = (),
              num_partitions: int | None = None) -> DataFrame:
    """What a box plot draws: quartiles, whiskers (most extreme values inside
    the fences) and the number of outliers, per group.

    The input is read once: collapsed to (group, value, count), it gives the
    quartiles, and its rows then meet their group's fences in salted parts
    that are aggregated before the group is.
    """
    keys = list(keys)
    c = collapse(df, value, keys)
    pos = position_stats(c, value, keys, num_partitions, weight="_w")
    if keys:
        j = join_salted(c, pos, keys, value, ["lower_fence", "upper_fence"])
    else:
        st = pos.select(F.struct("lower_fence", "upper_fence").alias("st")).scalar()
        j = c.withColumns({"lower_fence": st.getField("lower_fence"),
                           "upper_fence": st.getField("upper_fence")})
    inside = (F.col(value) >= F.col("lower_fence")) & (F.col(value) <= F.col("upper_fence"))
    parts = _group(j, [*keys, "_salt"] if keys else [],
                   F.min(F.when(inside, F.col(value))).alias("_lo"),
                   F.max(F.when(inside, F.col(value))).alias("_hi"),
                   F.sum(F.when(~inside, F.col("_w"))).alias("_out"))
    w = _group(parts, keys, F.min("_lo").alias("lower_whisker"), F.max("_hi").alias("upper_whisker"),
               F.coalesce(F.sum("_out"), F.lit(0)).alias("n_outliers"))
    if keys:
        out = pos.join(w, keys)
    else:
        cols = ("lower_whisker", "upper_whisker", "n_outliers")
        st = w.select(F.struct(*cols).alias("st")).scalar()
        out = pos.withColumns({c_: st.getField(c_) for c_ in cols})
    return out.select(*keys, "q1", F.col("q2").alias("median"), "q3", "lower_whisker",
                      "upper_whisker", "n_outliers")
