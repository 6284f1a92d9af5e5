"""Plan properties of every registered query: no cross products or nested
loop joins, no row-at-a-time Python, pruned scans, broadcast view joins."""

import re

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

QUERIES = E.queries()
MODEL_BASED = {"elbow", "kmeans_labels", "pca2"}


def _plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_BASED))
def test_no_pair_explosion_or_row_udf(spark, name):
    p = _plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in p, (name, bad)


def test_fact_scan_is_pruned_and_view_joins_broadcast(spark):
    p = _plan(spark, "rank_mean_active_l1")
    schemas = re.findall(r"lineitem\.parquet\], [^\n]*ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all(s == "struct<l_orderkey:bigint,l_extendedprice:double>" for s in schemas)
    # statistics and sizes at runtime choose the joins, no hint and no counting job
    df = QUERIES["rank_mean_active_l1"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in final and "BroadcastHashJoin" in final


def test_filter_reaches_scan(spark):
    p = _plan(spark, "filter_eq")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(r_name,ASIA\)", p)


def test_quantile_offsets_and_rows_share_one_exchange(spark):
    df = QUERIES["position_stats"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # cut points, offsets and rows read one aggregate; the parts are explicit, not Spark's sampled ranges
    assert "ReusedExchange" in final and "Subquery" in final
    assert "rangepartitioning" not in final and "MapInPandas" not in final


def test_place_join_without_broadcast_same_result(spark):
    from pyspark.sql import functions as F
    from zonestats.plans.standins import DriverTables, census, departments, municipalities, services, towns
    from zonestats.plans.star import star_view
    t = DriverTables(spark, SF_SMALL)
    parts = (services(t), towns(t), municipalities(t), departments(t), census(t))
    small = star_view(*parts)
    big = star_view(*(p.hint("merge") for p in parts))
    cols = ["town_id", "peak_ts", "active_energy", "dept_name", "population"]
    assert small.select(cols).exceptAll(big.select(cols)).count() == 0
    assert big.select(cols).exceptAll(small.select(cols)).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = big.groupBy("dept_name").agg(F.sum("active_energy"))._jdf.queryExecution() \
               .executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in p


def test_declared_unique_census_drops_unused_join(spark):
    from zonestats.operators.rank import rank_by
    from zonestats.plans.standins import DriverTables, census, departments, municipalities, services, towns
    from zonestats.plans.star import SHORT_LABELS as L
    from zonestats.plans.star import star_view
    t = DriverTables(spark, SF_SMALL)
    parts = (services(t), towns(t), municipalities(t), departments(t), census(t))

    def plan_and_rows(unique, measure):
        v = star_view(*parts, census_unique=unique)
        r = rank_by(v, L.level_keys[1], measure, "sum", scale=2)
        return r._jdf.queryExecution().optimizedPlan().toString().count("Join "), sorted(r.collect())

    joins_default, rows_default = plan_and_rows(False, L.active)
    joins_unique, rows_unique = plan_and_rows(True, L.active)
    assert joins_unique == joins_default - 1 and rows_unique == rows_default
    # census columns used: same result (customer keys are unique in this data)
    assert plan_and_rows(True, L.population)[1] == plan_and_rows(False, L.population)[1]


def test_a_hot_group_is_dealt_by_its_own_size(spark):
    """One group with a third of all distinct values over 400 partitions: no
    partition of the join with its parameters gets 2 % of the rows."""
    from pyspark.sql import functions as F
    from zonestats.operators.joins import heavy_groups, join_salted
    rows = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).cast("long").alias("g"),
                                       F.col("id").cast("double").alias("v"))
    per_group = rows.groupBy("g").agg(F.max("v").alias("top"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [tuple(r) for r in heavy_groups(rows, ["g"]).collect()] == [(-1, 267)]
        out = join_salted(rows, per_group, ["g"], "v", ["top"])
        parts = out.groupBy("g", "_salt").count().collect()
        assert sum(r["count"] for r in parts) == 120_000 and out.where("v > top").count() == 0
        tasks = {}
        key = F.pmod(F.hash("g", "_salt"), F.lit(400))  # where an exchange on the join's keys sends a row
        for r in out.groupBy(key.alias("p")).count().collect():
            tasks[r["p"]] = r["count"]
        assert max(tasks.values()) < 0.02 * 120_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
