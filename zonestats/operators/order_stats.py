"""Exact ranks and quantiles that scale with hot groups and hot values.

Spark's exact ``percentile``/``median`` aggregates merge a map of every
distinct value of a group inside one task; a group holding a third of a
100 TB table would not fit. Window functions partitioned by the group have
the same single-task problem. Here ranks are computed instead from a range
partitioning on (group, value).

Quantiles (``exact_quantiles``):

1. Collapse to one row per distinct (group, value) with its multiplicity,
   a partial aggregate: a (group, value) pair holding a third of all rows
   becomes one row before any shuffle, and duplicates never travel.
2. Explicit cut points (``range_parts``): the distinct rows whose hash is
   below a threshold, about ``SAMPLE`` for each part, are sorted and every
   so-many-th is a cut. A row's part is the number of cuts not above it, found
   by bisection. Both are functions of the data alone: a part holds the same
   rows whichever exchange it is read from, in every retry, and whether or not
   the session reuses exchanges. A hot group is cut like the rest.
3. Per (part, group) totals, at most #groups + #parts rows, give each segment
   its offset inside the group and the group size by a window over that small
   table.
4. Inside a segment a running sum of the multiplicities, a window bounded by
   the size of a part, then the offset by a join on (part, group), which keeps
   a hot group spread; AQE broadcasts the small table.
5. Each collapsed row covers the rank interval [before, before + count);
   only rows covering an interpolation rank survive, then a tiny groupBy.

Interpolation follows numpy's "linear" method bit for bit, including its
symmetric form ``hi - (hi - lo) * (1 - t)`` for ``t >= 0.5``; the median of
an even count is ``(lo + hi) / 2`` like pandas' median.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 32  # rows sampled for each part


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Parts: explicit, else the shuffle partition setting."""
    return max(1, int(num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def range_parts(rows: DataFrame, order: Sequence[str], n_parts: int, out: str = "_part",
                weight: str | None = None) -> DataFrame:
    """Adds ``out``, 0 to ``n_parts`` - 1, growing with ``order`` (ascending,
    missing last). ``rows`` are distinct in ``order``.

    The cut points are one scalar subquery: an array of ``n_parts`` - 1 rows
    from about ``SAMPLE`` times as many, whatever the size of ``rows``. With the
    count ``weight`` of an aggregate, counting and drawing need its result, so
    neither is pushed below it to scan its input again; its exchange serves all."""
    if n_parts == 1:
        return rows.withColumn(out, F.lit(0))
    at = F.struct(*[x for i, c in enumerate(order) for x in (F.isnull(c).alias(f"n{i}"), F.col(c).alias(f"c{i}"))])
    one = F.signum(weight) if weight else F.lit(1.0)
    total = rows.agg(F.sum(one)).scalar()
    draw = F.shiftrightunsigned(F.xxhash64(*order), 1).cast("double")
    drawn = rows.where(draw * total * one < F.lit(2.0**63 * SAMPLE * n_parts)).agg(F.array_sort(F.collect_list(at)).alias("s"))
    step = F.size("s") / F.lit(float(n_parts))
    cuts = drawn.select(F.transform(F.sequence(F.lit(1), F.lit(n_parts - 1)),
                                    lambda i: F.get("s", F.floor(i * step).cast("int")))).scalar()
    # bisection, one step a projection: ``out`` counts the cuts known to be at or below the row
    parts = rows.withColumn(out, F.lit(0))
    for bit in reversed(range((n_parts - 1).bit_length())):
        below = F.get(cuts, F.col(out) + F.lit((1 << bit) - 1)) <= at
        parts = parts.withColumn(out, F.col(out) + F.when(below, F.lit(1 << bit)).otherwise(F.lit(0)))
    return parts


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n_parts: int) -> DataFrame:
    """``rows``, distinct in ``keys`` (without missing ones) and ``order``, each
    standing for ``_w`` rows, with ``_before`` (rows of the group that come
    earlier in ``order``, missing last) and ``_n`` (rows of the group)."""
    keys, order = list(keys), list(order)
    parts = range_parts(rows, [*keys, *order], n_parts, weight="_w")
    totals = parts.groupBy("_part", *keys).agg(F.sum("_w").alias("_t"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *keys, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"),
                            F.sum("_t").over(group).alias("_n"))
    here = Window.partitionBy("_part", *keys).orderBy(*[F.asc_nulls_last(c) for c in order]) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.withColumn("_to", F.sum("_w").over(here))
    return local.join(offsets, ["_part", *keys]).select(
        *rows.columns, (F.col("_off") + F.col("_to") - F.col("_w")).alias("_before"), "_n")


def weighted_positions(df: DataFrame, keys: Sequence[str], value: str,
                       num_partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """One row per distinct (keys, value) with ``_w`` (multiplicity),
    ``_before`` (rows of the group with a smaller value) and ``_n``.

    ``weight`` names a count column of an input that is already collapsed
    to distinct (keys, value) rows (no further aggregation is done)."""
    keys = list(keys)
    if weight is None:
        src = _not_null(df.select(*keys, value), [*keys, value])
        collapsed = src.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    else:
        collapsed = _not_null(df.select(*keys, value, F.col(weight).cast("long").alias("_w")),
                              [*keys, value])
    return ranked(collapsed, keys, [value], _num_partitions(df, num_partitions))


def _lerp(lo: Column, hi: Column, t: Column) -> Column:
    diff = hi - lo
    return F.when(t >= F.lit(0.5), hi - diff * (F.lit(1.0) - t)).otherwise(lo + diff * t)


def _pname(p: float) -> str:
    return "q" + f"{p:g}".replace(".", "_").replace("-", "m")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    keys: Sequence[str] = (), names: Sequence[str] | None = None,
                    median_name: str | None = None,
                    num_partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact quantiles of ``value`` per group (numpy/pandas linear method).

    Returns one row per group: keys, one column per probability (``names``)
    and, if ``median_name`` is given, the pandas median as well. ``weight``:
    see ``weighted_positions`` (input already collapsed with counts).
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    if any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError(f"probabilities must lie in [0, 1]: {probs}")
    names = list(names) if names else [_pname(p) for p in probs]
    if len(names) != len(probs):
        raise ValueError("one name per probability")
    pos = weighted_positions(df, keys, value, num_partitions, weight)
    n1 = (F.col("_n") - F.lit(1)).cast("double")
    lo_end = F.col("_before") + F.col("_w")

    def covers(r: Column) -> Column:
        return (F.col("_before") <= r) & (r < lo_end)

    ranks: list[tuple[str, Column]] = []
    for i, p in enumerate(probs):
        h = n1 * F.lit(p)
        ranks += [(f"_lo{i}", F.floor(h)), (f"_hi{i}", F.ceil(h))]
    if median_name:
        ranks += [("_mlo", F.floor(n1 / F.lit(2.0))), ("_mhi", F.ceil(n1 / F.lit(2.0)))]
    wanted = F.lit(False)
    for _, r in ranks:
        wanted = wanted | covers(r)
    at = pos.where(wanted)
    aggs = [F.max(F.when(covers(r), F.col(value))).alias(name) for name, r in ranks]
    aggs += [F.max(n1 * F.lit(p) - F.floor(n1 * F.lit(p))).alias(f"_t{i}") for i, p in enumerate(probs)]
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("_c")]
    g = at.groupBy(*keys).agg(*aggs) if keys else at.agg(*aggs)
    out = [F.col(k) for k in keys]
    for i, name in enumerate(names):
        out.append(_lerp(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_t{i}")).alias(name))
    if median_name:
        out.append(((F.col("_mlo") + F.col("_mhi")) / F.lit(2.0)).alias(median_name))
    return g.select(*out)


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str | None = None,
                 num_partitions: int | None = None, weight: str | None = None) -> DataFrame:
    return exact_quantiles(df, value, [], keys, median_name=name or value,
                           num_partitions=num_partitions, weight=weight)
