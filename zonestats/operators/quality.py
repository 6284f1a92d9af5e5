"""Metadata and data-quality checks: profile, shape, missing keys, key audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and non-missing count
    (pandas ``info()``). All counts come from a single aggregate pass."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col("`" + f.name.replace("`", "``") + "`")).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = counts.unpivot([], [f"c{i}" for i in range(len(fields))], "_c", "non_null")
    meta = F.create_map(*[x for i, f in enumerate(fields)
                          for x in (F.lit(f"c{i}"), F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                                             F.lit(f.dataType.simpleString()).alias("dtype")))])
    of = F.element_at(meta, F.col("_c"))
    return rows.select(
        of["position"].alias("position"),
        of["column"].alias("column"),
        of["dtype"].alias("dtype"),
        F.col("non_null"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    """(rows, columns) as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def missing_keys(a: DataFrame, b: DataFrame, a_on: str, b_on: str | None = None,
                 cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct context rows of ``a`` whose key has no match in ``b``
    (left-anti join; replaces merge -> isna -> unique -> isin)."""
    b_on = b_on or a_on
    k = b.select(F.col(b_on).alias("_k"))
    anti = a.join(k, a[a_on] == k["_k"], "left_anti")
    return anti.select(*(cols or [a_on])).distinct()


def audit_keys(df: DataFrame, pk: Sequence[str],
               fks: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Primary/foreign key violations as rows (check, key, n).

    * ``duplicate_pk``: key values (joined with '|') seen more than once;
    * ``missing_pk``: rows with a missing key part (key is NULL);
    * ``fk:<col>``: non-missing values of ``col`` absent from the referenced
      column (left-anti join), with their row count.
    """
    pk = list(pk)
    parts = [f"_k{i}" for i in range(len(pk))]
    # one collapse by key serves both primary key checks
    seen = df.groupBy(*[F.col(c).alias(k) for c, k in zip(pk, parts)]).agg(F.count(F.lit(1)).alias("_n"))
    whole = reduce(and_, [F.col(k).isNotNull() for k in parts])
    bad = seen.where(~whole | (F.col("_n") > 1)).select(
        whole.alias("_whole"), *[F.when(whole, F.col(k)).alias(k) for k in parts], "_n")
    out = bad.groupBy("_whole", *parts).agg(F.sum("_n").alias("n")).select(
        F.when(F.col("_whole"), "duplicate_pk").otherwise("missing_pk").alias("check"),
        F.when(F.col("_whole"), F.concat_ws("|", *[F.col(k).cast("string") for k in parts])).alias("key"), "n")
    for col, (ref, ref_col) in (fks or {}).items():
        r = ref.select(F.col(ref_col).alias("_rk"))
        # counted per key first, so that only distinct keys meet the referenced table
        keys = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(
            keys.join(r, keys["_k"] == r["_rk"], "left_anti")
                .select(F.lit(f"fk:{col}").alias("check"), F.col("_k").cast("string").alias("key"), "n"))
    return out


def has_values(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
               out: str = "has_values") -> DataFrame:
    """True when every column in ``cols`` has at least one non-missing value
    (per group). A group or table without rows gives False / no group."""
    cond = None
    for c in cols:
        e = F.count(F.col(c)) > 0
        cond = e if cond is None else cond & e
    if keys:
        return df.groupBy(*keys).agg(cond.alias(out))
    return df.agg(F.coalesce(cond, F.lit(False)).alias(out))
