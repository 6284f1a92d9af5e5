"""Connected components of an edge table, as iterated joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestats.llm.common import saved


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has a link.

    ``links``: columns ``a``, ``b`` (long). Returns ``node``, ``root``.
    Alternating large-star and small-star steps (each edge moves to the
    smallest neighbour) until the edge set stands still; every step is a
    partial aggregate on the node and one join, and is written to the shared
    folder. Self links and repeated links are harmless; no links give no rows.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "cc-edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                                             .alias("e")).select("e.*").filter("u <> v").distinct())
        edges = saved(small, "cc-edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return saved(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "cc-roots")
