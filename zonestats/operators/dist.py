"""Distribution summaries: frequency table with equal-width classes, and a
Gaussian kernel density on a fixed grid. Both work per group.

Frequency table (pandas ``cut`` semantics): the number of classes is
floor(log2(n + 1)) with n counting *all* rows of the group (missing values
included, as the reference does); edges are ``linspace(min, max, bins+1)``
with the first edge lowered by 0.1 % of the range, classes are right-closed
``(lo, hi]``; a constant column is widened by 0.1 % of its value (0.001 for
zero). Empty classes are kept with count 0. A value's class is the number
of edges below it. Cumulative columns are running sums over at most ~log2(n)
class rows per group.

Density (scipy ``gaussian_kde(bw_method=0.1)`` on ``linspace(min, max,
grid)``): bandwidth h = 0.1 * sample std, y(g) = sum_i exp(-((g - x_i)/h)^2/2)
/ (n h sqrt(2 pi)). The sum is a fast Gauss transform with a bound on its
relative error. Values fall into boxes of width 2 r h; with u and t the distances of
a value and of a grid point to the box's centre, in h, the kernel is
exp(-t^2/2) exp(-u^2/2) exp(t u), and the last factor is a Taylor series of
``TERMS`` terms. So a box needs only its moments, sum of w exp(-u^2/2) u^k:
plain aggregates, combined before any shuffle, however large the group. Where
|t| > 39 the kernel is below the smallest double; elsewhere |t u| <= z = 39 r,
and the series is off by at most z^TERMS / TERMS! e^(2z), 4e-13 of the kernel.
The cost is TERMS steps for each distinct value and 1000 TERMS for each box that
holds any; values k deviations out number at most n / k^2, so a group has
O(n^(1/3)) such boxes, and one task can turn a group's boxes into grid sums.
Constant or one-value groups have no density (scipy raises) and give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from zonestats.functions.columns import float_text
from zonestats.operators.joins import join_salted


def _group(src: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return src.groupBy(*keys).agg(*aggs) if keys else src.agg(*aggs)


def _attach(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], value: str,
            cols: Sequence[str]) -> DataFrame:
    """Add per-group parameters to rows: by a salted join on the keys, or as
    scalar subqueries for the whole-column case (no join at all)."""
    if keys:
        return join_salted(rows, per_group, keys, value, cols)
    st = per_group.select(F.struct(*cols).alias("st")).scalar()
    return rows.withColumns({c: st.getField(c) for c in cols})


def round_frac(x: Column, precision: int | Column = 3) -> Column:
    """pandas' label rounding: ``precision`` decimals, or ``precision``
    significant fractional digits when |x| < 1."""
    prec = F.lit(precision) if isinstance(precision, int) else precision
    frac = x - F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    whole = x - frac
    digits = F.when(whole == 0, -F.floor(F.log10(F.abs(frac))) - 1 + prec) \
              .otherwise(prec).cast("int")
    p = F.pow(F.lit(10.0), digits)
    rounded = F.rint(x * p) / p
    return F.when((x == 0) | F.isnan(x), x).otherwise(rounded)


def label_precision(edges: Column, base: int = 3) -> Column:
    """pandas' precision inference for class labels: the smallest precision
    from ``base`` up to 19 at which the rounded edges are all distinct
    (``base`` if none is). Evaluated once per group on its edge array."""
    def distinct_at(p: int) -> Column:
        rounded = F.transform(edges, lambda e: round_frac(e, p))
        return F.size(F.array_distinct(rounded)) == F.size(edges)
    expr = F.when(distinct_at(base), F.lit(base))
    for p in range(base + 1, 20):
        expr = expr.when(distinct_at(p), F.lit(p))
    return expr.otherwise(F.lit(base))


def interval_label(lo: Column, hi: Column, precision: int | Column = 3) -> Column:
    return F.concat(F.lit("("), float_text(round_frac(lo, precision)), F.lit(", "),
                    float_text(round_frac(hi, precision)), F.lit("]"))


def frequency_table(df: DataFrame, value: str, keys: Sequence[str] = (),
                    bins: int | None = None, precision: int = 3) -> DataFrame:
    """Absolute, cumulative and relative (%) frequencies per class."""
    keys = list(keys)
    src = df.select(*keys, value)
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    # one pass: distinct (group, value) with counts, the missing value kept
    # as its own row so that n still counts it
    c = src.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    g = _group(c, keys, F.sum("_w").alias("_n_all"),
               F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("_w"))), F.lit(0)).alias("_n"),
               F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    nb = F.lit(int(bins)) if bins else F.floor(F.log2(F.col("_n_all") + 1)).cast("int")
    g = g.withColumn("_bins", nb).where((F.col("_bins") > 0) & (F.col("_n") > 0))
    mn, mx = F.col("_mn"), F.col("_mx")
    widen = lambda v: F.when(v != 0, F.lit(0.001) * F.abs(v)).otherwise(F.lit(0.001))
    const = mn == mx
    start = F.when(const, mn - widen(mn)).otherwise(mn)
    stop = F.when(const, mx + widen(mx)).otherwise(mx)
    g = g.withColumn("_start", start).withColumn("_stop", stop)
    step = (F.col("_stop") - F.col("_start")) / F.col("_bins")
    first = F.when(const, F.col("_start")).otherwise(
        F.col("_start") - (F.col("_stop") - F.col("_start")) * F.lit(0.001))
    edges = F.transform(
        F.sequence(F.lit(0), F.col("_bins")),
        lambda i: F.when(i == 0, first).when(i == F.col("_bins"), F.col("_stop"))
                   .otherwise(i.cast("double") * step + F.col("_start")))
    g = g.withColumn("_edges", edges)
    g = g.withColumn("_prec", label_precision(F.col("_edges"), precision))

    rows = _attach(c.where(F.col(value).isNotNull()), g, keys, value, ["_edges"]) \
        .where(F.col("_edges").isNotNull())
    cls = F.size(F.filter(F.col("_edges"), lambda e: e < F.col(value)))
    counts = rows.groupBy(*keys, cls.alias("class")).agg(F.sum("_w").alias("freq"))

    classes = g.select(*keys, "_n", "_edges", "_prec",
                       F.explode(F.sequence(F.lit(1), F.col("_bins"))).alias("class"))
    t = classes.join(counts, [*keys, "class"], "left")
    t = t.select(
        *keys, "class",
        F.element_at(F.col("_edges"), F.col("class")).alias("lower"),
        F.element_at(F.col("_edges"), F.col("class") + 1).alias("upper"),
        F.coalesce(F.col("freq"), F.lit(0)).alias("freq"), "_n", "_prec",
    )
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("class") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rel = F.col("freq") / F.col("_n") * F.lit(100.0)
    t = t.withColumn("rel_freq", rel)
    return t.select(
        *keys, "class", "lower", "upper",
        interval_label(F.col("lower"), F.col("upper"), F.col("_prec")).alias("interval"),
        "freq", F.sum("freq").over(w).alias("cum_freq"),
        "rel_freq", F.sum("rel_freq").over(w).alias("cum_rel_freq"),
    ).orderBy(*keys, "class")


HALF_WIDTH = 0.025  # r: half a box, in bandwidths
TERMS = 16


def _box_moments(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per group and box with its centre ``_c`` and ``_k0`` to
    ``_k<TERMS - 1>``, the sums of w exp(-u^2/2) u^k."""
    width = F.col("_h") * F.lit(2 * HALF_WIDTH)
    boxes = rows.withColumn("_box", F.floor((F.col(value) - F.col("_mn")) / width))
    boxes = boxes.withColumn("_c", F.col("_mn") + (F.col("_box") + F.lit(0.5)) * width)
    boxes = boxes.withColumn("_u", (F.col(value) - F.col("_c")) / F.col("_h"))
    boxes = boxes.withColumn("_k0", F.col("_w") * F.exp(F.col("_u") * F.col("_u") * F.lit(-0.5)))
    for k in range(1, TERMS):
        boxes = boxes.withColumn(f"_k{k}", F.col(f"_k{k - 1}") * F.col("_u"))
    return boxes.groupBy(*keys, "_n", "_h", "_mn", "_mx", "_c").agg(
        *[F.sum(f"_k{k}").alias(f"_k{k}") for k in range(TERMS)])


def _kernel_sums(keys: list[str], grid: int):
    """Per batch and group: the sum of the kernels of its boxes at every
    grid point. Rows come sorted by group, so a group is met in few batches."""
    factor = np.array([1.0 / math.factorial(k) for k in range(TERMS)])

    def sums(one: pd.DataFrame) -> pd.DataFrame:
        h, mn, mx = (float(one[c].iloc[0]) for c in ("_h", "_mn", "_mx"))
        x = np.arange(grid) * ((mx - mn) / (grid - 1)) + mn
        x[-1] = mx
        c, total = one["_c"].to_numpy(), np.zeros(grid)
        moments = one[[f"_k{k}" for k in range(TERMS)]].to_numpy() * factor
        for i in range(0, len(c), 256):
            t = np.clip((x[:, None] - c[None, i:i + 256]) / h, -40.0, 40.0)
            series = np.broadcast_to(moments[i:i + 256, -1], t.shape)
            for k in range(TERMS - 2, -1, -1):
                series = series * t + moments[i:i + 256, k]
            total += (np.exp(-0.5 * t * t) * series).sum(axis=1)
        first = one[[*keys, "_n", "_h", "_mn", "_mx"]].iloc[:1]
        return first.loc[first.index.repeat(grid)].assign(point=np.arange(grid, dtype=np.int32), _s=total)

    def run(batches):
        for pdf in batches:
            groups = [g for _, g in pdf.groupby(keys, sort=False, dropna=False)] if keys else [pdf] if len(pdf) else []
            for i in range(0, len(groups), 64):
                yield pd.concat([sums(g) for g in groups[i:i + 64]], ignore_index=True)
    return run


def kde(df: DataFrame, value: str, keys: Sequence[str] = (), bw: float = 0.1,
        grid: int = 1000) -> DataFrame:
    """Gaussian kernel density on ``grid`` equally spaced points from the
    group's min to max. Columns: keys, point (0-based), x, density."""
    keys = list(keys)
    src = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    # the input is read once: everything below uses its collapse to
    # (group, value, multiplicity)
    collapsed = src.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    g1 = _group(collapsed, keys, F.sum("_w").alias("_n"),
                (F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("_m"),
                F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    dev = _attach(collapsed, g1, keys, value, ["_n", "_m", "_mn", "_mx"])
    # sample variance, two-pass (deviations from the mean) for stability
    ss = F.sum(F.col("_w") * F.pow(F.col(value) - F.col("_m"), 2)).alias("_ss")
    own = [*keys, "_n", "_mn", "_mx"]  # (_n, _mn, _mx) are constant per group
    parts = dev.groupBy(*own, *(["_salt"] if keys else [])).agg(ss)
    g = parts.groupBy(*own).agg(
        (F.lit(float(bw)) * F.sqrt(F.sum("_ss") / F.nullif(F.col("_n") - 1, F.lit(0)))).alias("_h"))
    g = g.where(F.col("_h").isNotNull() & (F.col("_h") > 0))
    rows = _attach(collapsed, g, keys, value, ["_n", "_h", "_mn", "_mx"]).where(F.col("_h").isNotNull())
    rows = rows.select(*keys, value, "_w", "_n", "_h", "_mn", "_mx")
    boxes = _box_moments(rows, keys, value)
    if keys:  # a group's boxes meet in one task, which gives each grid point once
        boxes = boxes.repartition(*keys).sortWithinPartitions(*keys)
    kept = [boxes.schema[c] for c in (*keys, "_n", "_h", "_mn", "_mx")]
    sums = boxes.mapInPandas(_kernel_sums(keys, grid), StructType(
        [*kept, StructField("point", IntegerType()), StructField("_s", DoubleType())]))
    agg = sums.groupBy(*keys, "point", "_n", "_h", "_mn", "_mx").agg(F.sum("_s").alias("_s"))
    step = (F.col("_mx") - F.col("_mn")) / F.lit(float(grid - 1))
    x = F.when(F.col("point") == grid - 1, F.col("_mx")) \
         .otherwise(F.col("point").cast("double") * step + F.col("_mn"))
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2.0 * math.pi))
    return agg.select(*keys, "point", x.alias("x"), (F.col("_s") / norm).alias("density")) \
              .orderBy(*keys, "point")
