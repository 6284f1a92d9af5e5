"""Projections, casts, recodes, filters and row-set operations (cleaning job)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from zonestats.functions.columns import (
    RAW_TIMESTAMP_FORMAT,
    complement_pct,
    day_name,
    nan_to_null,
    parse_ts,
    recode_expr,
    strict_int,
)


# ---- projections -----------------------------------------------------------

def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column subset; a name listed twice is projected once."""
    seen: list[str] = []
    for c in cols:
        if c not in seen:
            seen.append(c)
    return df.select(*seen)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*cols)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """Ingest rule: NaN in any float column becomes NULL (missing)."""
    return df.select(*[
        nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ])


def strict_int_cast(df: DataFrame, cols: Iterable[str], to: str = "int") -> DataFrame:
    """Cast columns to integers; bad text or a fractional value raises."""
    cols = set(cols)
    return df.select(*[strict_int(c, to).alias(c) if c in cols else F.col(c) for c in df.columns])


def float_to_int(df: DataFrame, to: str = "bigint") -> DataFrame:
    """Every float column to a nullable integer (ids that became floats; NaN is missing)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    clean = df.select(*[nan_to_null(c).alias(c) if c in floats else F.col(c) for c in df.columns])
    return strict_int_cast(clean, floats, to)


def recode(df: DataFrame, col: str, mapping: Mapping, out: str | None = None,
           value_type: str | None = None) -> DataFrame:
    """Dictionary recode; values outside the mapping become NULL."""
    return df.withColumn(out or col, recode_expr(col, mapping, value_type))


def with_complement(df: DataFrame, col: str, out: str, whole: float = 100.0) -> DataFrame:
    return df.withColumn(out, complement_pct(col, whole))


def parse_timestamp(df: DataFrame, col: str, fmt: str = RAW_TIMESTAMP_FORMAT,
                    out: str | None = None, strict: bool = True) -> DataFrame:
    return df.withColumn(out or col, parse_ts(col, fmt, strict))


def with_day_name(df: DataFrame, ts_col: str, out: str = "day_name") -> DataFrame:
    return df.withColumn(out, day_name(ts_col))


def unpivot_pair(df: DataFrame, cols: Sequence[str], var: str = "variable",
                 value: str = "value", ids: Sequence[str] = ()) -> DataFrame:
    """Wide -> long (pandas ``melt``): one row per (input row, column)."""
    return df.unpivot(list(ids), list(cols), var, value)


# ---- filters -----------------------------------------------------------------

def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def null_rows(df: DataFrame, col: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Rows where ``col`` is missing, in a stated order."""
    out = df.where(F.col(col).isNull())
    return out.orderBy(*[F.asc_nulls_last(c) for c in order_by]) if order_by else out


def dropna_any(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value (in ``subset`` or any column)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def semi_filter(df: DataFrame, keys: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in the computed key set (``isin`` as a
    left-semi join; the key set is never collected to the driver)."""
    right_on = right_on or left_on
    k = keys.select(F.col(right_on).alias("_k"))
    return df.join(k, df[left_on] == k["_k"], "left_semi")


# ---- row sets ----------------------------------------------------------------

def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_first(df: DataFrame, subset: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep one row per ``subset`` value: the first in the stated order
    (ties broken by the remaining columns, so the result is deterministic).

    A ``min_by`` aggregate: partial aggregation map-side, no window, so a
    hot subset value never lands whole in one task.
    """
    subset = list(subset)
    others = [c for c in df.columns if c not in subset]
    order = list(order_by) + [c for c in others if c not in order_by]
    picked = df.groupBy(*subset).agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) for c in subset], *[F.col(f"_row.{c}").alias(c) for c in others]) \
                 .select(*df.columns)
