"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonestats.llm.common import saved, shuffle_partitions, words

WEIGHTS = (5, 2, 1)
CHUNK = 8192  # documents of a first-level group of the tree
FAN_IN = 256  # residuals of a group of the levels above


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources``: source, source_size, docs. Adds rank and target.

    Sources rank by code point, null last, and their weights repeat. Targets
    share ``share`` times all sizes by weight; none exceeds ``cap`` times its
    source, and the excess is shared again. Ranks come from a range sort and
    offsets per partition; the level of sharing from one aggregate per round.
    """
    n = shuffle_partitions(sources.sparkSession)
    order = F.col("source").asc_nulls_last()
    laid = saved(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = laid.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = laid.join(F.broadcast(before), "part").withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    ranked = saved(ranked.select("source", "source_size", "docs", "rank", weight.cast("double").alias("weight"),
                                 (F.col("source_size") * cap).alias("limit")), "mix-ranked")
    goal = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while goal:
        over = F.col("limit") <= F.col("weight") * level
        row = ranked.agg(F.sum(F.when(over, F.col("limit")).otherwise(0.0)).alias("full"),
                         F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        new = (goal - row["full"]) / row["free"] if row["free"] else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return ranked.select("source", "source_size", "docs", "rank",
                         F.least("limit", F.col("weight") * level).alias("target"))


def _uniform(a: int, b: int, level: int, seed: int) -> float:
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + level * 0x165667B19E3779F9 + seed) & 0xFFFFFFFFFFFFFFFF
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * mul) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def transfer(pi: float, si: int, pj: float, sj: int, u: float) -> tuple[float, float]:
    """Move words between two documents until one probability is 0 or 1.

    si * pi + sj * pj stays, and so does the expectation of either."""
    up, down = min(si * (1 - pi), sj * pj), min(si * pi, sj * (1 - pj))
    if u * (up + down) < down:  # i gains
        return (1.0, pj - up / sj) if si * (1 - pi) <= sj * pj else (pi + up / si, 0.0)
    return (0.0, pj + down / sj) if si * pi <= sj * (1 - pj) else (pi - down / si, 1.0)


def _integral(p: float) -> bool:
    return p < 1e-9 or p > 1 - 1e-9


def offset(rows: list[tuple], first: int, want: float) -> None:
    """Offset the words that rounding a source's last residual added or took:
    turn the document of the root group whose size is nearest to the miss,
    while that brings the source nearer to its target."""
    miss = sum(r[4] for r in rows[first:] if r[7]) - want
    for _ in range(8):
        fit = min((i for i in range(first, len(rows)) if rows[i][7] == int(miss > 0)),
                  key=lambda i: (abs(abs(miss) - rows[i][4]), rows[i][6]), default=None)
        if fit is None or abs(abs(miss) - rows[fit][4]) >= abs(miss):
            return
        turned = 1 - rows[fit][7]
        miss += rows[fit][4] * (1 if turned else -1)
        rows[fit] = (*rows[fit][:7], turned)


def _pair_up(batches: Iterator[pa.RecordBatch], level: int, root: bool, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows come grouped by (rank, chunk), larger documents first: pair each
    with the one left over. ``up`` is 1, 0, or null for a group's residual."""
    group = held = None
    rows: list[tuple] = []
    first, want = 0, 0.0  # where the group's rows begin; the words it should take

    def settle(row, p):
        rows.append((*row[:5], p, row[6], int(p > 0.5)))

    def leave(row, p):
        if root:
            settle(row, float(p >= 0.5))
        else:
            rows.append((*row[:5], p, row[6], None))

    names = ["rank", "chunk", "rid", "docs", "size", "p", "mark", "up"]
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64()]

    def flush():
        cols = list(zip(*rows)) if rows else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names[:7])):
            if (row[0], row[1]) != group:
                if held:
                    leave(*held)
                if root:
                    offset(rows, first, want)
                    yield flush()
                    rows = []
                group, held, first, want = (row[0], row[1]), None, len(rows), 0.0
            p = row[5]
            want += p * row[4]
            if held is None:
                held = (row, p)
                continue
            other, q = held
            q, p = transfer(q, other[4], p, row[4], _uniform(other[6], row[6], level, seed))
            held = None
            for r, x in ((other, q), (row, p)):
                if _integral(x):
                    settle(r, round(x))
                else:
                    held = (r, x)
        if not root:
            yield flush()
            rows = []
    if held:
        leave(*held)
    if root:
        offset(rows, first, want)
    yield flush()


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share: float = 1.5, cap: float = 2.0, seed: int = 7, chunk: int = CHUNK, fan_in: int = FAN_IN,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """Copies of each document, so that every source comes near its target.

    A document's size is its number of words. Its expected copies are target /
    source_size, at most ``cap``; the whole part is certain, the fraction goes
    through pivotal rounding: documents of a source are paired in groups of
    about ``chunk`` (dealt by a hash of the id, so a hot source is many
    groups), words move at random between the two until one fraction is 0 or
    1, and the groups' residuals meet in groups of ``fan_in`` on the next
    level, up to one residual a source. Words are kept by every transfer, so
    a source misses its target by at most half its last document, and that
    miss is offset within the root group (``offset``).

    Returns one row per input row: doc_id, source, size, source_size, target,
    copies, taken (copies * size), and the input's columns ``carry``. Reruns
    agree: choices hash the ids.
    A null text has size 0; documents of size 0 round alone and take nothing;
    a source without words has target 0. Null sources are one source, the
    last. Rows that repeat an id are documents of their own. An empty table
    gives no rows; other columns are ignored.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        F.size(words(F.col(text_col))).cast("long").alias("size"), *carry)
    sizes = saved(sizes.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = saved(source_targets(sources, weights, share, cap), "mix-targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(F.col("rate") + 1e-12), F.lit(int(cap))).cast("long")
    rows = (sizes.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("rate", rate)
            .withColumn("base", base).withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
            .withColumn("mark", F.xxhash64("doc_id", "size")))
    rows = saved(rows.drop("of", "rate"), "mix-rows")

    open_ = F.col("p").between(1e-9, 1 - 1e-9)
    todo = rows.filter(open_ & (F.col("size") > 0)).select(
        "rank", F.pmod(F.xxhash64("mark", F.lit(seed)), F.ceil(F.col("docs") / chunk)).alias("chunk"),
        "rid", "docs", "size", "p", "mark")
    groups = max(1, -(-(targets.agg(F.max("docs")).first()[0] or 0) // chunk))
    settled, level = [], 0
    while True:
        root = groups == 1
        n = shuffle_partitions(docs.sparkSession)
        dealt = todo.repartition(n, "rank", "chunk").sortWithinPartitions("rank", "chunk", F.desc("size"), "mark", "rid")
        done = saved(dealt.mapInArrow(partial(_pair_up, level=level, root=root, seed=seed),
                                      "rank long, chunk long, rid long, docs long, size long, p double, mark long, up long"),
                     "mix-level")
        settled.append(done.filter("up is not null").select("rid", "up"))
        if root:
            break
        todo = done.filter("up is null").withColumn("chunk", F.floor(F.col("chunk") / fan_in)).drop("up")
        groups, level = -(-groups // fan_in), level + 1
    ups = settled[0]
    for more in settled[1:]:
        ups = ups.unionByName(more)
    alone = F.when(F.pmod(F.xxhash64("mark", F.lit(seed)), F.lit(1 << 30)) / (1 << 30) < F.col("p"), 1).otherwise(0)
    out = rows.join(ups, "rid", "left").withColumn("copies", F.col("base") + F.coalesce("up", alone))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"), *carry)
