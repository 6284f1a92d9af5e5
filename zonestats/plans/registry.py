"""Registry of named queries over the driver tables, each with its SQL oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``. Where an exact SQL statement
exists it is registered with it (DuckDB dialect, the driver tables as views).
Doubles in registered results are rounded (``rounded``) because the two
engines add floating values in different orders; the library operators
themselves never round unless the operator is defined to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int | None = 6,
            per_column: dict[str, int | None] | None = None) -> DataFrame:
    """Round double columns (half away from zero, like SQL ``round``).

    ``per_column`` overrides ``digits`` per column; ``None`` leaves a column
    as computed (for values both engines produce with the same operations).
    """
    per_column = per_column or {}
    cols = []
    for f in df.schema.fields:
        d = per_column.get(f.name, digits)
        if isinstance(f.dataType, (DoubleType, FloatType)) and d is not None:
            cols.append(F.round(F.col(f.name), d).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
