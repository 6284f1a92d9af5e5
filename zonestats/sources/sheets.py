"""Sheets exported to text: rows cut by their position.

A sheet is a file, or the files of a folder in name order. Its rows are read by
many tasks, so no task knows a row's position; the rows of each file split are
counted, and running offsets over the splits say in which splits the first and
the last rows lie. Only those few splits have anything cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a sheet: value, and where each lies: file, block (first
    byte of its split) and nth (a number that grows within a split)."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"))


def cut_positions(lines: DataFrame, lead: int, tail: int) -> DataFrame:
    """``read_lines`` rows without the first ``lead`` and the last ``tail`` of
    the whole sheet, in any order; value only.

    Lines are scanned twice: to count the splits, and to be returned. A split
    that has a row to cut has at least one row, so at most lead + tail splits
    are joined to the lines (broadcast); their other rows, and all rows of the
    other splits, pass. A sheet of lead + tail rows or fewer has none left.
    """
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("nth").alias("first"))
    order = Window.orderBy("file", "block")  # one row per split
    placed = splits.withColumns({"end": F.sum("rows").over(order), "total": F.sum("rows").over(Window.partitionBy())}) \
        .withColumn("begin", F.col("end") - F.col("rows"))
    cuts = placed.filter((F.col("begin") < lead) | (F.col("end") > F.col("total") - tail)).select(
        "file", "block", (F.col("first") + F.lit(lead) - F.col("begin")).alias("from"),
        (F.col("first") + F.col("total") - F.lit(tail) - F.col("begin")).alias("until"))
    kept = F.col("from").isNull() | ((F.col("nth") >= F.col("from")) & (F.col("nth") < F.col("until")))
    return lines.join(F.broadcast(cuts), ["file", "block"], "left").filter(kept).select("value")


def read_sheet(spark: SparkSession, path: str, schema: StructType | str, lead: int, tail: int = 0, sep: str = ",") -> DataFrame:
    """A sheet exported to CSV without its ``lead`` first rows (title rows and
    the header) and its ``tail`` last rows (notes), cut by position whatever
    they hold. The other rows are parsed strictly by ``schema``: a row that
    does not fit raises. A quoted value may hold the separator but no line
    break. A blank line is a row of missing values."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    rows = cut_positions(read_lines(spark, path), lead, tail)
    return rows.select(F.from_csv("value", ddl, {"sep": sep, "mode": "FAILFAST"}).alias("row")).select("row.*")
