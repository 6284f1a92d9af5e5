"""Dimension and fact building for the cleaning job.

* ``add_serial``: surrogate keys 1..n in a stated order. A window
  ``row_number()`` without partition would pull every row into one task;
  instead explicit cut points deal the distinct rows into parts, each part
  counts its rows, and a running sum over the (at most #partitions) counts
  gives each part its offset (``order_stats.ranked``).
* ``dim_build``: distinct values (optionally without missing) + serial key.
* ``dim_encode``: replace text attributes by dimension ids (left joins).
* ``fact_build``: parse the text timestamp, drop redundant columns.
* ``append_rows`` / ``apply_overrides``: the INSERT and keyed UPDATE steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestats.functions.columns import RAW_TIMESTAMP_FORMAT, parse_ts
from zonestats.operators.order_stats import _num_partitions, ranked

COPIES = 1 << 16  # equal rows numbered by one task at a time


def add_serial(df: DataFrame, id_col: str, order_by: Sequence[str] | None = None,
               num_partitions: int | None = None) -> DataFrame:
    """Append ``id_col`` = 1..n following ``order_by`` (then the other
    columns), ascending, missing last. Equal rows are numbered in a row: they
    travel as one row with a count and are dealt as blocks of ``COPIES``, so
    many copies load no task."""
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_w"))
    n = _num_partitions(df, num_partitions)
    r = _numbered(rows, order_by or [], n)
    blocks = r.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1, F.lit(COPIES).cast("long"))))
    blocks = blocks.repartition(n, "_before", "_at")
    first, last = F.col("_before") + F.col("_at"), F.col("_before") + F.least(F.col("_at") + COPIES, F.col("_w"))
    return blocks.select(*df.columns, F.explode(F.sequence(first + 1, last)).alias(id_col))


def _numbered(rows: DataFrame, order_by: Sequence[str], n_parts: int) -> DataFrame:
    """``rows``, distinct but for ``_w`` (how many rows each stands for), with
    ``_before``. The other columns break ties, so the order is deterministic."""
    own = [c for c in rows.columns if c != "_w"]
    return ranked(rows, [], [*order_by, *[c for c in own if c not in order_by]], n_parts)


def dim_build(df: DataFrame, cols: Sequence[str], id_col: str | None = None,
              dropna: bool = True, order_by: Sequence[str] | None = None) -> DataFrame:
    """Distinct attribute combinations, optionally without missing values,
    with an optional serial key (``id_col``) in the given order."""
    d = df.select(*cols)
    if dropna:
        d = d.dropna(how="any")
    if not id_col:
        return d.distinct()
    d = d.groupBy(*cols).agg(F.least(F.count(F.lit(1)), F.lit(1)).alias("_w"))
    r = _numbered(d, order_by or list(cols), _num_partitions(df, None))
    return r.select(*cols, (F.col("_before") + 1).alias(id_col))


def dim_encode(df: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str], str]],
               null_safe: bool = False, drop_attributes: bool = True) -> DataFrame:
    """Replace attribute columns by dimension ids.

    ``dims`` = [(dimension_df, attribute_columns, id_column), ...]. Each is
    a left join on the attributes (``null_safe`` lets missing match
    missing); attributes are then dropped. Dimension tables are small by
    construction but not bounded by definition, so the planner picks the
    join strategy (broadcast when small).
    """
    out = df
    for dim, attrs, id_col in dims:
        attrs = list(attrs)
        r = dim.select(*[F.col(a).alias(f"_d_{a}") for a in attrs], F.col(id_col))
        cond = None
        for a in attrs:
            e = out[a].eqNullSafe(r[f"_d_{a}"]) if null_safe else out[a] == r[f"_d_{a}"]
            cond = e if cond is None else cond & e
        out = out.join(r, cond, "left").drop(*[f"_d_{a}" for a in attrs])
        if drop_attributes:
            out = out.drop(*attrs)
    return out


def fact_build(df: DataFrame, ts_col: str, drop: Sequence[str] = (),
               fmt: str = RAW_TIMESTAMP_FORMAT, strict: bool = True) -> DataFrame:
    """Parse the timestamp text column in place and drop redundant columns."""
    return df.withColumn(ts_col, parse_ts(ts_col, fmt, strict)).drop(*drop)


def append_rows(df: DataFrame, rows: Sequence[Mapping]) -> DataFrame:
    """INSERT of literal rows; columns a row leaves out are NULL."""
    if not rows:
        return df
    schema = df.schema
    fields = {f.name: f for f in schema.fields}
    lit_rows = []
    for r in rows:
        unknown = set(r) - set(fields)
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        lit_rows.append(tuple(r.get(f.name) for f in schema.fields))
    extra = df.sparkSession.createDataFrame(lit_rows, schema)
    return df.unionByName(extra)


def apply_overrides(df: DataFrame, fixes: DataFrame, key: str, col: str) -> DataFrame:
    """Keyed correction (``UPDATE t SET col = v WHERE key = k``): a left join
    with the fixes. A fix to NULL takes effect; a key with two fixes raises."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("two fixes for key "), F.col("_fk").cast("string")))
                  .cast(fixes.schema[col].dataType)).otherwise(F.first("_fv"))
    f = (fixes.select(F.col(key).alias("_fk"), F.col(col).alias("_fv")).groupBy("_fk")
         .agg(once.alias("_fv"), F.lit(True).alias("_hit")))
    j = df.join(f, df[key] == f["_fk"], "left")
    return j.select(*[F.when(F.col("_hit"), F.col("_fv")).otherwise(F.col(c)).alias(c) if c == col else F.col(c)
                      for c in df.columns])


def census_build(sheet: DataFrame, names: Mapping[str, str], whole: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """The census table from the data rows of its sheet: unnamed columns get
    their ``names``, the ``whole`` columns become integers (bad text or a
    fraction raises; missing stays missing), the ``drop`` columns, which the
    place tables already hold, go."""
    from zonestats.operators.clean import drop_columns, rename_columns, strict_int_cast
    unknown = sorted(set(names) - set(sheet.columns))
    if unknown:
        raise ValueError(f"columns not found: {unknown}")
    return drop_columns(strict_int_cast(rename_columns(sheet, names), whole, "int"), drop)
