"""Exact deduplication by a 128-bit content hash, checked byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestats.llm.common import WHITE_RUN, saved


def normalised(text: Column) -> Column:
    """Text with every run of [\\x20\\x09-\\x0D] as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """Groups of equal normalised texts; the smallest id of a group stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256. One scan writes id, 128-bit hash and digest; groups are
    counted on the hash with map-side partial counts. Only texts whose hash
    occurs twice or more are read again: they are grouped by (hash, text),
    where equality is of bytes and copies collapse before the shuffle. If a
    hash holds one text, its rows take that group by the hash; if it holds
    several (a collision), they take theirs by hash and text.

    Null counts as empty. A null id stays only where its group has no id.
    Of repeated rows (one id, one text) that carry the smallest id one stays,
    the others come back with kept = false. An empty table gives no rows;
    other columns are ignored. ``hash_fn`` maps the text to its hash.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = src.withColumn("h", hash_fn(F.col("norm")))
    prints = saved(keyed.select("doc_id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "exact-prints")
    units = saved(prints.groupBy("doc_id", "h", "text_sha256").agg(F.count("*").alias("copies")), "exact-units")
    sizes = saved(units.groupBy("h").agg(F.sum("copies").alias("n")).filter("n > 1").select("h"), "exact-hashes")

    same = (keyed.join(sizes, "h", "left_semi").groupBy("h", "norm")
            .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"))
    same = saved(same, "exact-groups")
    # the digest tells the texts of a collided hash apart; each row of `same` is one text by its bytes
    out = units.join(same, ["h", "text_sha256"], "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256", "copies")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", "text_sha256", first.alias("first"),
                      F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")) \
        .select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256")
