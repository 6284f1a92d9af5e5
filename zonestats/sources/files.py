"""File sources and sinks (CSV, parquet) with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV scan with an explicit schema (no inference pass over the data).
    A UTF-8 byte-order mark at the start of the header is dropped."""
    r = spark.read.option("header", header).option("sep", sep).option("encoding", encoding) \
        .option("mode", "FAILFAST")
    if schema is not None:
        # header names are checked against the schema instead of taken by position
        r = r.schema(schema).option("enforceSchema", not header)
        df = r.csv(path)
        return df
    df = r.option("inferSchema", False).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def read_preamble_csv(spark: SparkSession, path: str, schema: StructType | str,
                      is_data: Column, sep: str = ",") -> DataFrame:
    """A sheet exported to CSV with title rows above the header and note
    rows below the data: read headerless as text; rows satisfying ``is_data``
    (on the columns as far as they convert, e.g. the code is a number) are
    kept and cast strictly, so bad text in a data row raises. Position-free,
    so the scan stays split across tasks."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = StructType([StructField(f.name, StringType()) for f in schema])
    raw = spark.read.option("header", False).option("sep", sep).schema(text).csv(path)
    tried = raw.select(F.struct(*raw.columns).alias("_raw"), *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
    return tried.where(is_data).select(*[F.col("_raw")[f.name].cast(f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index, UTF-8; one file per task (no funnel through one
    writer)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def is_number(col: str) -> Column:
    """Predicate: the text column parses as a number."""
    return F.try_cast(F.col(col), "double").isNotNull() if hasattr(F, "try_cast") \
        else F.expr(f"try_cast(`{col}` AS double)").isNotNull()
