"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonestats.session import scratch_dir

# The characters [\x20\x09-\x0D], as a trim set and as a Java pattern of a run.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared checkpoint folder and
    read it back: lineage is cut, and lost executors lose no work."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The runs of characters outside ``WHITE`` as an array; null has none."""
    body = F.btrim(text, F.lit(WHITE))
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.array().cast("array<string>")) \
        .otherwise(F.split(body, WHITE_RUN))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def smallest_by_hash(rows: DataFrame, key: str, n: int, salts: int = 64) -> DataFrame:
    """Of each ``key`` the ``n`` rows with the smallest hash of ``doc_id``. The
    hash deals a key's rows to ``salts`` groups that are cut to ``n`` first, so
    a key that holds most rows is not one task's work."""
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    for keys in ((key, "salt"), (key,)):
        order = Window.partitionBy(*keys).orderBy("h", F.col("doc_id").asc_nulls_last())
        rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n).drop("n")
    return rows.drop("salt")


def join_by_weight(rows: DataFrame, table: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """Left join of ``rows`` (a written table) with ``table``, which has one row
    per ``key``, where some keys hold a large part of the rows.

    Keys with more than 1 / ``parts`` of all rows are fewer than ``parts`` at
    any size: their part of ``table`` is broadcast and their rows stay where
    they are. The others meet in a merge join, in which no key is large. Null
    keys match nothing.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.agg(F.count(F.lit(1)).alias("_all")).select("_all").scalar()
    heavy = saved(counts.filter(F.col("_rows") * parts > total).select(key, F.lit(True).alias("_heavy")), "heavy-keys")
    heavy = F.broadcast(heavy)  # fewer than ``parts`` rows
    marked = rows.join(heavy, key, "left")
    own = [c for c in table.columns if c != key]
    large = marked.filter("_heavy").drop("_heavy").join(F.broadcast(table.join(heavy.drop("_heavy"), key, "left_semi")), key, "left")
    small = marked.filter("_heavy IS NULL").drop("_heavy").join(table.hint("merge"), key, "left")
    cols = [*rows.columns, *own]
    return large.select(*cols).unionByName(small.select(*cols))
