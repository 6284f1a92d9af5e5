"""Quality rules: a hashed n-gram log-likelihood ratio of a trusted target
against the raw corpus, beside plain rules on words and lines. Built from
DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestats.llm.common import saved, words

BUCKETS = 1 << 14
# runs of letters, digits and everything outside ASCII, or runs of ASCII marks
_TOKENS = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]+"
TRUSTED_DOCS = 20_000  # rows of the trusted sample, by smallest hash of the id
PRIOR = 1.0  # added to a bucket's count on either side
LEAST = -0.3  # least mean log ratio of a kept document


def _features(text: Column, buckets: int) -> tuple[Column, Column]:
    """Tokens; hashed one- and two-token buckets of column ``t``."""
    t = F.col("t")
    one = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(t, lambda x, i: F.pmod(F.xxhash64(x, F.get(t, i + 1)), F.lit(buckets)).cast("int"))
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKENS), F.lit(0))
    return tokens, F.when(F.size(t) > 0, F.concat(one, F.slice(two, F.lit(1), F.size(t) - 1))).otherwise(
        F.array().cast("array<int>"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", size: int = TRUSTED_DOCS) -> DataFrame:
    """At most ``size`` ids with label 1, by smallest hash; one column ``doc_id``."""
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id"))
    return good.filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def bucket_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """The log ratio of every bucket.

    Raw counts cover every n-gram of every document; target counts those of
    the trusted documents. A bucket's weight is ln((t + prior) / (r * T / R +
    prior)), 0 where there is no target. ``trusted`` must be bounded (it is
    broadcast); counts are partial sums over at most ``buckets`` keys.
    """
    tokens, feats = _features(F.col(text_col), buckets)
    mark = F.broadcast(trusted.select(F.col("doc_id").alias("good_id")))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), tokens.alias("t"))
            .select("id", feats.alias("f")).join(mark, F.col("id") == F.col("good_id"), "left")
            # the outer form: an inferred filter on the array would evaluate it again, per token
            .select(F.explode_outer("f").alias("bucket"), F.col("good_id").isNotNull().alias("good")))
    counts = rows.filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("r"), F.count_if("good").alias("t"))
    counts = saved(counts, "quality-counts")
    total = counts.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("T"), F.coalesce(F.sum("r"), F.lit(0)).alias("R")).first()
    share = total["T"] / total["R"] if total["R"] else 0.0
    weights = [0.0] * buckets
    if total["T"]:
        for r in counts.collect():  # at most ``buckets`` rows
            weights[r["bucket"]] = round(math.log((r["t"] + prior) / (r["r"] * share + prior)), 6)
    return weights


def _repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words from the array ``w``: words that lie in a 3-word
    window found twice or more. Equal windows are neighbours once the hashed
    windows are sorted; only documents that have any are sorted."""
    w, g, s, at = F.col("w"), F.col("g"), F.col("s"), F.col("at")
    df = df.withColumn("g", F.when(F.size(w) >= 3, F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.size(w) - 2)))
    df = df.withColumn("s", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(
        F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter(s, lambda e, k: F.coalesce(e["h"] == F.get(s, k - 1)["h"], F.lit(False))
                    | F.coalesce(e["h"] == F.get(s, k + 1)["h"], F.lit(False)))
    df = df.withColumn("at", F.sort_array(F.transform(same, lambda e: e["i"])))
    gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get(at, k - 1), F.lit(3))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def quality(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text",
            least: float = LEAST, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Score and judge every document in one scan, without a shuffle.

    ``weights`` comes from ``bucket_weights`` and enters the plan as one
    folded array constant of fixed length.
    Returns one row per input row: row (a struct of the input's columns),
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score (mean log ratio of the n-grams; 0 without any).
    base_failed: n_words < ``min_words`` or 100 * n_repeat_words >
    ``max_repeat_percent`` * n_words. kept: not base_failed and score >=
    ``least``. A null or empty text has no words and fails; rows that repeat
    are judged alike; an empty table gives no rows.
    """
    text = F.col("text")
    tokens, feats = _features(text, len(weights))
    df = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("w", words(text)).withColumn("t", tokens)
    df = _repeats(df).withColumn("f", feats)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", F.when(F.contains(text, F.lit("\n")), lines))
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    score = F.aggregate(F.col("f"), F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size("f")
    n_words = F.size("w").cast("long")
    df = df.select(
        "row", "doc_id", n_words.alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.when(F.size("f") > 0, score).otherwise(0.0).alias("score"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def accepted(docs: DataFrame, weights: list[float], **options) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their own columns.

    The verdict passes through a generator because a plain filter would be
    pushed below the projections and evaluate their arrays once per word.
    """
    judged = quality(docs, weights, **options)
    held = judged.select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return held.filter("row is not null").select("row.*")
