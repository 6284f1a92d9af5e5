"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonestats.llm.common import WHITE, lower_ascii, saved, shuffle_partitions
from zonestats.session import scratch_dir

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _hash(line: Column) -> tuple[Column, Column]:
    """128 bits of a line's key."""
    return F.xxhash64(line_key(line)), F.xxhash64(F.lit(0x5EED), line_key(line))


class LineRuns:
    """Sorted runs of line hashes in levels.

    A run is a table bucketed and sorted by the hash, so that joins and merges
    of runs need no shuffle of them. ``add`` takes a batch of (h1, h2, doc_id)
    rows: it merge-anti-joins the batch with every run to find the lines that
    no run holds, then writes the batch's own run. New lines carry the largest
    doc_id of the batch, known lines only their count, so batches that come in
    descending doc_id keep each line's largest document. ``fan_in`` runs of a
    level are merged into one run of the next.
    """

    def __init__(self, spark: SparkSession, fan_in: int = 3, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.written: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.select("h1", "h2", "docs", "last_doc").repartition(self.buckets, *KEY)
         .write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", scratch_dir(self.spark, name)).saveAsTable(name))
        self.written.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run out of several, by merge joins of the sorted runs. (Not an
        aggregate over their union: Spark 4.1 takes the union of bucketed
        tables as bucketed and leaves out the exchange.)"""
        return reduce(lambda a, b: a.select("h1", "h2", F.col("docs").alias("d"), F.col("last_doc").alias("l"))
                      .join(b.hint("merge"), KEY, "full")
                      .select("h1", "h2", (F.coalesce("d", F.lit(0)) + F.coalesce("docs", F.lit(0))).alias("docs"),
                              F.greatest("l", "last_doc").alias("last_doc")), runs)

    def novel(self, entries: DataFrame) -> DataFrame:
        return reduce(lambda left, run: left.join(run.select(*KEY).hint("merge"), KEY, "left_anti"), self.runs(), entries)

    def add(self, batch: DataFrame) -> None:
        entries = batch.distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last_doc"))
        if not self.runs():
            own = entries
        else:
            entries = saved(entries, "line-batch")
            new = self.novel(entries)
            known = entries.join(new.select(*KEY), KEY, "left_anti").withColumn("last_doc", F.lit(None).cast("long"))
            own = new.unionByName(known)
        self.levels[0].append(self._write(own))
        self._compact()

    def _compact(self) -> None:
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fan_in:
                run = self._write(self.merged([self.spark.table(n) for n in self.levels[depth]]))
                self.levels[depth] = []
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(run)

    def forget(self) -> None:
        """Remove the runs' names from the catalogue."""
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """Remove lines that many documents hold, but for the largest document.

    A line's key is the line with [\\x20\\x09-\\x0D] stripped at both ends and
    A-Z lowered. Keys of ``min_chars`` code points or more that are found in
    ``min_docs`` documents or more lose all their lines, except in the largest
    doc_id that holds them. Returns one row per input row: row (a struct of
    the input's columns), doc_id, text (the lines kept, joined by \\n),
    n_lines, n_dropped.

    One scan writes (hash, document) of the long lines; ``batches`` ranges of
    ids in descending order go through ``LineRuns``; the runs' merged counts
    give the lines to drop, which meet their document's text in one merge join
    at every size (the lists grow with the input). Counts are partial aggregates, so a line in a third of all documents is one row per
    task; joins on line or id are left to AQE's skew splitting.

    A null or empty text is one empty line. Rows that share an id count as one
    document, and so do all rows without id (the smallest one). An empty
    table gives no rows. Columns named like the result's are in ``row``.
    """
    spark = docs.sparkSession
    src = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = src.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000).alias("q")).first()["q"] or []
    batch = reduce(lambda a, c: a + F.when(F.col("id") <= c, 1).otherwise(0), sorted(set(cuts)), F.lit(0))

    line = F.col("line")
    lines = (src.select("id", F.explode(F.split("text", "\n")).alias("line"))
             .filter(F.length(line_key(line)) >= min_chars)
             .select("id", *(h.alias(n) for h, n in zip(_hash(line), KEY))).distinct())
    lines = saved(lines.withColumn("batch", batch), "line-keys")

    store = LineRuns(spark, fan_in)
    for b in range(len(set(cuts)) + 1):
        store.add(lines.filter(F.col("batch") == b).select("h1", "h2", F.col("id").alias("doc_id")))
    bad = saved(store.merged(store.runs()).filter(F.col("docs") >= min_docs).select("h1", "h2", "last_doc"), "line-bad")
    store.forget()

    drops = (lines.select("id", *KEY).join(bad, KEY).filter("id <> last_doc")
             .groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop")))
    drops = saved(drops, "line-drops").withColumnRenamed("id", "drop_id")
    joined = src.join(drops.hint("merge"), src["id"] == drops["drop_id"], "left").select("row", "doc_id", "text", "drop")

    def stays(line: Column) -> Column:
        h1, h2 = _hash(line)
        return ~((F.length(line_key(line)) >= min_chars)
                 & F.array_contains(F.col("drop"), F.struct(h1.alias("h1"), h2.alias("h2"))))

    cut = joined.withColumn("lines", F.split("text", "\n")).withColumn(
        "stay", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    return cut.select("row", "doc_id", F.array_join("stay", "\n").alias("text"),
                      F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"))
