"""Cascading selection: name -> code lookups, child options, time series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonestats.operators.rank import exact_sum


def lookup_id(df: DataFrame, id_col: str, name_col: str, name,
              scope: Mapping[str, object] | None = None) -> DataFrame:
    """Code of the row with this name: the smallest code when names repeat
    (deterministic, unlike an unordered first row), optionally restricted
    by parent codes (``scope={'dept_id': 3}``). One row, NULL if absent."""
    src = df.where(F.col(name_col) == F.lit(name))
    for c, v in (scope or {}).items():
        src = src.where(F.col(c) == F.lit(v))
    return src.agg(F.min(id_col).alias(id_col))


def lookup_id_sql(spark: SparkSession, table: str, id_col: str, name_col: str, name) -> DataFrame:
    """The same lookup as parameterised SQL: identifiers and the value are
    bound, never pasted into the text."""
    return spark.sql(
        "SELECT min(IDENTIFIER(:id_col)) AS result FROM IDENTIFIER(:tbl) "
        "WHERE IDENTIFIER(:name_col) = :name",
        args={"id_col": id_col, "tbl": table, "name_col": name_col, "name": name},
    )


def lookup_ids(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Every name with its smallest code and the number of codes sharing it
    (homonyms show up with n_codes > 1)."""
    return (df.where(F.col(name_col).isNotNull())
              .groupBy(name_col)
              .agg(F.min(id_col).alias(id_col), F.count_distinct(id_col).alias("n_codes")))


def child_options(df: DataFrame, child: str, parent: str | None = None, value=None) -> DataFrame:
    """Sorted distinct children of one parent code (missing last)."""
    src = df.where(F.col(parent) == F.lit(value)) if parent else df
    return src.select(child).distinct().orderBy(F.asc_nulls_last(child))


def time_series(df: DataFrame, ts: str, cols: Sequence[str], key: str | None = None,
                key_value=None) -> DataFrame:
    """One entity's rows sorted by time, or (``key_value=None``) every
    entity's series sorted by (key, time); rows of one time by ``cols``."""
    if key is not None and key_value is not None:
        return df.where(F.col(key) == F.lit(key_value)).select(ts, *cols).orderBy(ts, *cols)
    rest = [c for c in cols if c != key]
    return df.select(*([key] if key else []), ts, *rest).orderBy(*([key] if key else []), ts, *rest)


def time_series_mean(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (),
                     scale: int | None = None, out: str | None = None) -> DataFrame:
    """Mean of ``value`` per timestamp (what a line plot draws for repeated
    x values), per entity when ``keys`` are given."""
    keys = list(keys)
    agg = (exact_sum(value, scale) / F.count(value)) if scale is not None else F.avg(value)
    return df.groupBy(*keys, ts).agg(agg.alias(out or value)).orderBy(*keys, ts)
