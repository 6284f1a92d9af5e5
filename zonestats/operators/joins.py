"""Join helpers: keyed left joins and null-safe joins.

A side is hinted for broadcast only where its size is bounded by definition
(a table fixed by a specification, one row per partition). Everything else is
left to the planner: ``spark.sql.autoBroadcastJoinThreshold`` (bytes from
statistics) and AQE (bytes at runtime) choose broadcast, else a sort-merge
join with AQE skew-join splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 2  # parts of a heavy group hold about 1 / (SHARES * shuffle partitions) of all rows


def left_join_keys(left: DataFrame, right: DataFrame, left_on: Sequence[str],
                   right_on: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left join on differently named key columns (all right columns kept)."""
    if len(left_on) != len(right_on):
        raise ValueError("left_on and right_on differ in length")
    cond = None
    for a, b in zip(left_on, right_on):
        c = left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
        cond = c if cond is None else cond & c
    return left.join(right, cond, "left")


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join where missing keys match each other (pandas ``merge`` on NaN).
    Output keeps one copy of each key column."""
    on = list(on)
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                     *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def heavy_groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _parts): the groups that hold more than an even share of the rows,
    with the number of shares in them. There are fewer of them than shares, at
    any size, so the table may be broadcast."""
    shares = SHARES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    share = counts.agg((F.sum("_rows") / F.lit(shares)).alias("_share")).select("_share").scalar()
    return counts.where(F.col("_rows") > share).select(*keys, F.ceil(F.col("_rows") / share).cast("int").alias("_parts"))


def join_salted(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], value: str,
                cols: Sequence[str]) -> DataFrame:
    """Rows with their group's parameters ``cols``. A heavy group's rows are
    dealt by a hash of ``value`` to as many parts (column ``_salt``) as it has
    shares, and its one row of parameters is copied to each; other groups are
    one part. So no group is one task's work, however large; aggregate by
    (keys, _salt) first, then by keys."""
    heavy = F.broadcast(heavy_groups(rows, keys))
    part = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(value)), F.col("_parts")).cast("int"))
    dealt = rows.join(heavy, [*keys], "left").withColumn("_salt", part).drop("_parts")
    copies = per_group.select(*keys, *cols).join(heavy, [*keys], "left").select(
        *keys, *cols, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_salt"))
    return dealt.join(copies, [*keys, "_salt"])
