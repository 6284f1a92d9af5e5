"""Hierarchical rankings and shares of total (the dashboard's 20 reports).

One operator covers them all: ``rank_by(view, keys, value, fn)`` with the
level's name keys, the measure and the aggregate. Each call is one
``groupBy`` with partial (map-side) aggregation; ``nunique`` is planned by
Catalyst as a two-level aggregate keyed by (keys, value), so a department
holding a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = ("avg", "mean", "sum", "nunique", "count", "min", "max")


def unscaled(value: str, scale: int) -> Column:
    """A fixed-point measure with ``scale`` decimals as an exact integer
    count of 10^-scale units (``rint`` recovers the integer the double
    stands for). A value with more decimals raises: the distance to the
    integer may be what a few roundings of the double, or of larger values it
    was subtracted from, leave: a millionth, or a 2^-50 of the value."""
    y = F.col(value) * F.lit(float(10**scale))
    rounding = F.least(F.greatest(F.abs(y) * F.lit(2.0**-50), F.lit(1e-6)), F.lit(0.4))
    return F.when(F.abs(y - F.rint(y)) > rounding, F.raise_error(F.concat(
        F.lit(f"more than {scale} decimals: "), F.col(value).cast("string"))).cast("long")).otherwise(F.rint(y).cast("long"))


LIMB = 16  # bits: sums of limbs are exact for 2^47 rows (or weights) of any values


def exact_units(value: str, scale: int, weight: str | None = None) -> Column:
    """Exact sum of units as a decimal, each counted ``weight`` times. A value
    is four limbs of 16 bits, each summed as a 64-bit integer, so that no sum
    of fewer than 2^47 rows overflows, whatever the values, and the sums stay
    as fast as integer sums are; the limbs meet as decimals, once a group."""
    u = unscaled(value, scale)
    total = None
    for at in range(0, 64, LIMB):
        limb = F.shiftright(u, at) if at == 64 - LIMB else F.shiftright(u, at).bitwiseAND(F.lit(2**LIMB - 1))
        part = F.sum(limb * F.col(weight) if weight else limb).cast("decimal(20,0)") * F.lit(1 << at).cast("decimal(16,0)")
        total = part if total is None else total + part
    return total


def exact_sum(value: str, scale: int, weight: str | None = None) -> Column:
    """Sum of a fixed-point measure with ``scale`` decimals, done on exact
    integers so the result does not depend on partitioning or summation
    order, then returned as a double (one rounding, one division)."""
    return exact_units(value, scale, weight).cast("double") / F.lit(float(10**scale))


def _agg_expr(fn: str, value: str, scale: int | None = None) -> Column:
    if fn in ("avg", "mean"):
        if scale is not None:
            return exact_sum(value, scale) / F.count(value)
        return F.avg(value)
    if fn == "sum":
        # pandas sums an all-missing group to 0; SQL gives NULL
        s = exact_sum(value, scale) if scale is not None else F.sum(value)
        return F.coalesce(s, F.lit(0).cast("double"))
    if fn == "nunique":
        return F.count_distinct(F.col(value))
    if fn == "count":
        return F.count(value)
    if fn == "min":
        return F.min(value)
    if fn == "max":
        return F.max(value)
    raise ValueError(f"unknown aggregate {fn!r}; expected one of {AGGREGATES}")


def rank_by(df: DataFrame, keys: Sequence[str], value: str, fn: str = "avg",
            out: str | None = None, limit: int | None = None,
            dedupe_on: Sequence[str] | None = None, scale: int | None = None) -> DataFrame:
    """Aggregate ``value`` per ``keys`` and sort descending (missing last,
    keys ascending as tie-break).

    * rows with a missing key are dropped, as a pandas ``groupby`` does;
    * ``fn="sum"`` of an all-missing group is 0;
    * ``dedupe_on`` (e.g. the town key) counts each such entity once per
      group, for census values that the view repeats on every service row;
    * ``limit`` turns the full sort into a top-k (``TakeOrderedAndProject``);
    * ``scale``: the measure is fixed-point with that many decimals; sums
      and means are then exact and reproducible (see ``exact_sum``).
    """
    keys = list(keys)
    out = out or value
    src = df
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    if dedupe_on:
        # one row per (keys, entity); the repeated value is equal on all rows
        src = src.groupBy(*keys, *dedupe_on).agg(F.max(value).alias(value))
    res = src.groupBy(*keys).agg(_agg_expr(fn, value, scale).alias(out))
    res = res.orderBy(F.desc_nulls_last(out), *[F.asc_nulls_last(k) for k in keys])
    return res.limit(limit) if limit is not None else res


def rank_levels(df: DataFrame, levels: Sequence[Sequence[str]], value: str, fn: str = "avg", out: str | None = None,
                dedupe_on: Sequence[str] = (), scale: int | None = None, level_col: str = "level") -> DataFrame:
    """``rank_by`` at several ``levels`` of one hierarchy, with one scan.

    Columns: ``level_col`` (1 for the first level), every level's keys (NULL
    where a level lacks them) and ``out``; sorted by level, then as ``rank_by``
    sorts. The input is aggregated once to the union of the keys (for
    ``nunique`` with the values, with ``dedupe_on`` with the entities); only
    those rows are expanded into the grouping sets, which add up exact parts.
    A row without a key is missing from the levels that have this key only.
    """
    if fn not in AGGREGATES:
        raise ValueError(f"unknown aggregate {fn!r}; expected one of {AGGREGATES}")
    sets = [list(keys) for keys in levels]
    keys = list(dict.fromkeys(k for one in sets for k in one))
    marks = [sum(1 << i for i, k in enumerate(reversed(keys)) if k not in one) for one in sets]
    if len(set(marks)) < len(marks):
        raise ValueError("two levels have the same keys")
    out = out or value
    total = exact_units(value, scale) if scale is not None else F.sum(value)
    unit = float(10**scale) if scale is not None else 1.0
    whole = F.sum("_total").cast("double") / F.lit(unit) if scale is not None else F.sum("_total")
    if fn == "nunique" or dedupe_on:
        entity = list(dedupe_on)
        fine = df.groupBy(*keys, *entity).agg(F.max(value).alias("_v")) if entity else \
            df.select(*keys, F.col(value).alias("_v")).distinct()
        last = _agg_expr(fn, "_v", scale)
    else:
        entity = []
        fine = df.groupBy(*keys).agg(total.alias("_total"), F.count(value).alias("_n"),
                                     F.min(value).alias("_min"), F.max(value).alias("_max"))
        last = {"avg": whole / F.nullif(F.sum("_n"), F.lit(0)), "mean": whole / F.nullif(F.sum("_n"), F.lit(0)),
                "sum": F.coalesce(whole, F.lit(0).cast("double")), "count": F.sum("_n"),
                "min": F.min("_min"), "max": F.max("_max")}[fn]
    level = F.lit(None).cast("int")
    for i, mark in enumerate(marks):
        level = F.when(F.col("_mark") == mark, F.lit(i + 1)).otherwise(level)
    fine = fine.select("*", *[F.col(e).alias(f"_e{i}") for i, e in enumerate(entity)])
    by_entity = [f"_e{i}" for i in range(len(entity))]
    if entity:
        g = fine.groupingSets([[*one, *by_entity] for one in sets], *keys, *by_entity).agg(
            F.grouping_id().alias("_id"), F.max("_v").alias("_v"))
        g = g.withColumn("_mark", F.shiftright("_id", len(entity))).groupBy("_mark", *keys).agg(last.alias(out))
    else:
        g = fine.groupingSets(sets, *keys).agg(F.grouping_id().alias("_mark"), last.alias(out))
    present = F.lit(True)
    for i, one in enumerate(sets):
        for k in one:
            present = present & (F.col(k).isNotNull() | (F.col(level_col) != i + 1))
    g = g.select(level.alias(level_col), *keys, out).where(present)
    return g.orderBy(level_col, F.desc_nulls_last(out), *[F.asc_nulls_last(k) for k in keys])


def top_k(df: DataFrame, keys: Sequence[str], value: str, k: int, fn: str = "sum",
          out: str | None = None, scale: int | None = None) -> DataFrame:
    return rank_by(df, keys, value, fn=fn, out=out, limit=k, scale=scale)


def share_of_total(df: DataFrame, labels: Sequence[str], value: str,
                   out: str = "share_pct", scale: int | None = None) -> DataFrame:
    """Pie data: the sum of ``value`` per label and its percent of the total.

    Equal labels are added up, as the chart does. The total is a scalar
    subquery over the per-label sums (evaluated once, no join); a zero total
    gives NULL shares. With ``scale`` the sums are exact decimals.
    """
    labels = list(labels)
    src = df
    for k in labels:
        src = src.where(F.col(k).isNotNull())
    if scale is not None:
        unit = F.lit(float(10**scale))
        g = src.groupBy(*labels).agg(exact_units(value, scale).alias("_s"))
        total = g.select(F.sum("_s").cast("double") / unit).scalar()
        g = g.select(*labels, F.coalesce(F.col("_s").cast("double") / unit, F.lit(0.0)).alias(value))
    else:
        g = src.groupBy(*labels).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
        total = g.select(F.sum(value)).scalar()
    return g.withColumn(out, F.col(value) / F.nullif(total, F.lit(0.0)) * F.lit(100.0))


def head_n(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order (a DataFrame has no row order)."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in order_by]).limit(n)


def tail_n(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """Last ``n`` rows in a stated order: a top-k on the reversed order,
    never a driver-side ``tail()`` of the whole table."""
    rev = df.orderBy(*[F.desc_nulls_first(c) for c in order_by]).limit(n)
    return rev.orderBy(*[F.asc_nulls_last(c) for c in order_by])
