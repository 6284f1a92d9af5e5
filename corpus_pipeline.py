"""Corpus pipeline: documents in, token counts of the mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows as Parquet in the shared folder and rereads them. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonestats.llm.byte_bpe import round_trip
from zonestats.llm.common import read_table, saved
from zonestats.llm.line_runs import dedup_lines
from zonestats.llm.mixing import mix
from zonestats.llm.near_dup import near_duplicates
from zonestats.llm.quality import accepted, bucket_weights, trusted_ids

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and the log-likelihood
    ratio. A null or empty text fails the base rules; rows that repeat, or have
    no id, are judged by their text; without trusted labels the ratio rejects
    nothing; no documents give none; all columns stay as they are."""
    weights = bucket_weights(docs, trusted_ids(read_table(spark, sf_dir, "labels")))
    return accepted(docs, weights)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that five or more documents share, but for the last one.
    Every row stays, an empty or null text as an empty one; rows without an id
    count as one document, before all others; no documents give none; the other
    columns stay as they are, n_chars becomes the text's new length."""
    out = dedup_lines(docs)
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    return out.select(*own, "text", F.length("text").cast("long").alias("n_chars")).select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` written once as ``row`` (its columns, whatever their names) with
    ``row_key``, which names each row where ids are null or repeat, and
    ``row_mark``, a hash of the row by which choices agree between runs."""
    return saved(docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("row_mark"),
                             F.monotonically_increasing_id().alias("row_key")), "pipeline-keyed")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group (five words, 0.8): one with
    the group's smallest id, by smallest hash of the row if several have it.
    A text without words is in no group; its repeated rows count once. No
    documents give none; all columns stay as they are. The row keys grow with
    the input, so they meet the texts in a merge join at every size."""
    rows = keyed(docs)
    found = near_duplicates(rows.select("row.doc_id", "row.text", "row_key", "row_mark"), carry=("row_key", "row_mark")).filter("kept")
    alone = F.when(F.col("n_shingles") == 0, F.col("row_mark"))
    group = F.when(F.col("n_shingles") > 0, F.col("component"))
    kept = found.groupBy(group.alias("group"), alone.alias("alone")).agg(
        F.min(F.struct("row_mark", "row_key"))["row_key"].alias("kept_key"))
    ids = saved(kept.select("kept_key"), "pipeline-kept").hint("merge")
    return rows.select("row", "row_key").join(ids, F.col("row_key") == F.col("kept_key"), "left_semi").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each row as often as the mix takes it. A null or empty text has
    no words and takes none of the mix's (it may stay or go); rows without a
    source are one source; repeated rows are documents of their own; no
    documents give none; all columns stay as they are."""
    rows = keyed(docs)
    taken = mix(rows.select("row.text", "row.source", "row_key", "row_mark"), id_col="row_mark", carry=("row_key",)).filter("copies > 0")
    taken = taken.select(F.col("row_key").alias("taken_key"), "copies")
    out = rows.select("row", "row_key").join(taken, F.col("row_key") == F.col("taken_key"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, and back. A null
    text counts as empty; repeated rows are encoded each; no documents give no
    rows; other columns are ignored."""
    return round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dup), ("mixing", mixing),
          ("byte bpe", byte_bpe)]

#: Hashed n-grams, min-max signatures and rounding have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
