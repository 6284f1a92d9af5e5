"""Clustering reports: standardise, summary, rule descriptions, labels,
elbow, k-means and principal components (whose SQL draws the same seeds and
takes the same steps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonestats.functions.columns import power_factor
from zonestats.operators.cluster import (
    GRID,
    KMEANS_MAX_ITER,
    KMEANS_TOL,
    RULE_HIGH_USE,
    RULE_LOW_POWER,
    RULE_MIXED,
    RULE_REACTIVE,
    RULE_VERY_LOW_PF,
    classify,
    cluster_input,
    cluster_summary,
    elbow,
    kmeans_labels,
    label_members,
    pca2,
    standardize,
)
from zonestats.operators.lloyd import PRIME
from zonestats.plans.registry import register, rounded
from zonestats.plans.standins import VIEW_SQL, DriverTables, driver_view
from zonestats.plans.star import SHORT_LABELS as L

V = f"WITH v AS ({VIEW_SQL})"
FEATURES = [L.active, L.reactive, L.power, L.hours, L.pf]
# decimals of the fixed-point measures (exact sums)
SCALES = {L.active: 2, L.reactive: 4, L.power: 2, L.hours: 2}
# Thresholds for the driver tables, chosen so every rule branch occurs
# (the defaults in operators.cluster are the reference's).
DRIVER_THRESHOLDS = {"active_high": 55000.0, "pf_low": 0.90, "power_low": 26.0, "pf_high": 0.95,
                     "reactive_high": 12000.0, "pf_very_low": 0.92}


def _features(spark, d):
    """Service rows with the five measures and the return flag as a given
    cluster label (lineitem joined to its order)."""
    t = DriverTables(spark, d)
    li, o = t["lineitem"], t["orders"]
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("cluster"),
        F.col("l_extendedprice").alias(L.active),
        (F.col("o_totalprice") * F.col("l_tax")).alias(L.reactive),
        F.col("l_quantity").alias(L.power),
        (F.col("l_discount") * F.lit(100.0)).alias(L.hours),
        power_factor(F.col("l_extendedprice"), F.col("o_totalprice") * F.col("l_tax")).alias(L.pf),
    )


_FEATURES_SQL = (
    "SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag AS cluster, l.l_extendedprice AS active_energy, "
    "o.o_totalprice * l.l_tax AS reactive_energy, l.l_quantity AS max_power, "
    "l.l_discount * 100.0 AS daily_hours, l.l_extendedprice / NULLIF(SQRT(POWER(l.l_extendedprice, 2) "
    "+ POWER(o.o_totalprice * l.l_tax, 2)), 0) AS power_factor "
    "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
)


def _mean_sql(c: str) -> str:
    if c in SCALES:
        return f"CAST(sum(CAST({c} AS DECIMAL(18, {SCALES[c]}))) AS DOUBLE) / count({c})"
    return f"avg({c})"


def _rint2_sql(e: str) -> str:
    return f"round_even(({e}) * 100.0, 0) / 100.0"


def _z_sql(c: str) -> str:
    return (f"round((x.{c} - s.m_{c}) / s.s_{c}, 6) AS {c}")


@register(
    "standardize",
    f"{V}, x AS (SELECT town_id, peak_ts, {', '.join(FEATURES)} FROM v), "
    "s AS (SELECT " + ", ".join(
        f"{_mean_sql(c)} AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
        for c in FEATURES) + " FROM x) "
    f"SELECT x.town_id, x.peak_ts, {', '.join(_z_sql(c) for c in FEATURES)} FROM x, s",
)
def _standardize(spark, d):
    v = driver_view(spark, d).select(L.town_id, L.ts, *FEATURES)
    z = standardize(v, FEATURES, scales=SCALES)
    return rounded(z, None, {c: 6 for c in FEATURES})


@register(
    "cluster_summary",
    f"WITH f AS ({_FEATURES_SQL}) SELECT cluster, "
    + ", ".join(f"{_rint2_sql(_mean_sql(c))} AS {c}" for c in FEATURES) + " FROM f GROUP BY cluster",
)
def _cluster_summary(spark, d):
    return cluster_summary(_features(spark, d), "cluster", FEATURES, scales=SCALES)


def _case_sql(t: dict) -> str:
    return (
        f"CASE WHEN active_energy > {t['active_high']} AND power_factor < {t['pf_low']} "
        f"THEN '{RULE_HIGH_USE}' "
        f"WHEN max_power < {t['power_low']} AND power_factor >= {t['pf_high']} "
        f"THEN '{RULE_LOW_POWER}' "
        f"WHEN reactive_energy > {t['reactive_high']} THEN '{RULE_REACTIVE}' "
        f"WHEN power_factor < {t['pf_very_low']} THEN '{RULE_VERY_LOW_PF}' "
        f"ELSE '{RULE_MIXED}' END"
    )


@register(
    "cluster_classify",
    f"{V}, s AS (SELECT town_id, "
    + ", ".join(f"{_rint2_sql(_mean_sql(c))} AS {c}" for c in FEATURES)
    + " FROM v GROUP BY town_id) "
    f"SELECT *, {_case_sql(DRIVER_THRESHOLDS)} AS description FROM s",
)
def _cluster_classify(spark, d):
    s = cluster_summary(driver_view(spark, d), L.town_id, FEATURES, scales=SCALES)
    return classify(s, L.active, L.reactive, L.power, L.pf, thresholds=DRIVER_THRESHOLDS)


@register(
    "label_members",
    f"WITH f AS ({_FEATURES_SQL}), s AS (SELECT cluster, "
    + ", ".join(f"{_rint2_sql(_mean_sql(c))} AS {c}" for c in FEATURES)
    + f" FROM f GROUP BY cluster), ds AS (SELECT cluster, {_case_sql(DRIVER_THRESHOLDS)} AS description "
    "FROM s) SELECT f.l_orderkey, f.l_linenumber, f.cluster, ds.description FROM f "
    "LEFT JOIN ds ON f.cluster = ds.cluster",
)
def _label_members(spark, d):
    f = _features(spark, d)
    s = classify(cluster_summary(f, "cluster", FEATURES, scales=SCALES),
                 L.active, L.reactive, L.power, L.pf, thresholds=DRIVER_THRESHOLDS)
    return label_members(f.select("l_orderkey", "l_linenumber", "cluster"), s, "cluster")


def _zrows(spark, d):
    """Service rows with complete features, standardised, read from a
    checkpoint; ``row_key`` names a row in the draws of the seeds."""
    f = _features(spark, d).drop("cluster").withColumn("row_key", F.col("l_orderkey") * F.lit(8) + F.col("l_linenumber"))
    return cluster_input(f, FEATURES, scales=SCALES)


KS, SEED, DIM = range(2, 10), 42, len(FEATURES)
_P, _G = PRIME, float(GRID)
_X = [f"x{i}" for i in range(DIM)]
# grid points of the standardised features, with a stated row key
_POINTS_SQL = (
    f"f AS ({_FEATURES_SQL}), g AS (SELECT * FROM f WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + "), "
    "s AS (SELECT " + ", ".join(f"{_mean_sql(c)} AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                                for c in FEATURES) + " FROM g), "
    "x AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS key, "
    + ", ".join(f"CAST(round_even((g.{c} - s.m_{c}) / s.s_{c} * {_G}, 0) AS BIGINT) AS x{i}" for i, c in enumerate(FEATURES))
    + " FROM g, s)"
)


def _distance_sql(centre: str, at: int = 0) -> str:
    """Squared distance to entries ``at`` + 1 ... of a list column."""
    return "(" + " + ".join(f"(x{i} - {centre}[{at + i + 1}]) * (x{i} - {centre}[{at + i + 1}])" for i in range(DIM)) + ")"


def _seeds_sql(k: int) -> str:
    """CTEs s0 ... of one row with the list ``c`` of a seed's grid points."""
    out, point = [], "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _X) + "]"
    for m in range(k):
        h0 = f"((key % {_P}) * 48271 + {SEED + m} * 69621) % {_P}"
        u = f"((h1 * 16807 + {SEED + m}) % {_P} + 1) / {_P + 1.0}"
        rows = f"SELECT *, (({h0}) * ({h0}) + 11) % {_P} AS h1 FROM x"
        if m == 0:
            out.append(f"s0 AS MATERIALIZED (SELECT {point} AS c FROM ({rows}) ORDER BY -ln({u}), key, {", ".join(_X)} LIMIT 1)")
            continue
        near = ", ".join(_distance_sql(f"s{i}.c") for i in range(m))
        near = f"least({near})" if m > 1 else near
        tables = ", ".join(f"s{i}" for i in range(m))
        out.append(f"s{m} AS MATERIALIZED (SELECT {point} AS c FROM (SELECT r.*, {near} AS far FROM ({rows}) r, {tables}) "
                   f"WHERE far > 0 ORDER BY -ln({u}) / far, key, {", ".join(_X)} LIMIT 1)")
    return ", ".join(out)


def _lloyd_sql(k: int) -> str:
    """Recursive CTE fit{k}: (it, c, done) with the flat list of the centres."""
    start = " || ".join(f"s{i}.c" for i in range(k))
    tables = ", ".join(f"s{i}" for i in range(k))
    dist = ", ".join(f"{_distance_sql('c', j * DIM)} AS d{j}" for j in range(k))
    least = "least(" + ", ".join(f"d{j}" for j in range(k)) + ")"
    label = "CASE " + " ".join(f"WHEN d{j} = {least} THEN {j}" for j in range(k)) + " END"
    new = ", ".join(f"coalesce(CAST(sum(x{i}) FILTER (lab = {j}) AS DOUBLE) / count(*) FILTER (lab = {j}), any_value(c)[{j * DIM + i + 1}])"
                    for j in range(k) for i in range(DIM))
    shift = " + ".join(f"(n[{i}] - c[{i}]) * (n[{i}] - c[{i}])" for i in range(1, k * DIM + 1))
    return (f"fit{k} AS (SELECT 0 AS it, {start} AS c, false AS done FROM {tables} UNION ALL "
            f"SELECT it + 1, n, {shift} <= (SELECT t FROM tol) FROM (SELECT any_value(it) AS it, any_value(c) AS c, [{new}] AS n "
            f"FROM (SELECT *, {label} AS lab FROM (SELECT x.*, fit{k}.it, fit{k}.c, {dist} FROM x, fit{k} "
            f"WHERE NOT fit{k}.done AND fit{k}.it < {KMEANS_MAX_ITER})) HAVING count(*) > 0)), "
            f"last{k} AS (SELECT c FROM fit{k} ORDER BY it DESC LIMIT 1)")


_TOL_SQL = (f"tol AS MATERIALIZED (SELECT {KMEANS_TOL} * (" + " + ".join(f"var_pop({x})" for x in _X) + f") / {DIM} AS t FROM x)")


@register(
    "elbow",
    f"WITH RECURSIVE {_POINTS_SQL}, {_seeds_sql(max(KS))}, {_TOL_SQL}, " + ", ".join(_lloyd_sql(k) for k in KS) + " "
    + " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS k, round(sum(least({', '.join(_distance_sql('c', j * DIM) for j in range(k))})) / {_G * _G}, 3) "
        f"AS inertia FROM x, last{k}" for k in KS),
)
def _elbow(spark, d):
    return rounded(elbow(_zrows(spark, d), FEATURES, ks=KS, seed=SEED, key="row_key"), 3)


_K = 4
_PARTS = [f"c[{j * DIM + 1}:{(j + 1) * DIM}]" for j in range(_K)]
_ORDER_SQL = "[" + ", ".join(" + ".join(f"CAST({_PARTS[i]} < {_PARTS[j]} AS INTEGER)" for i in range(_K) if i != j) for j in range(_K)) + "]"


@register(
    "kmeans_labels",
    f"WITH RECURSIVE {_POINTS_SQL}, {_seeds_sql(_K)}, {_TOL_SQL}, {_lloyd_sql(_K)}, "
    f"o AS (SELECT c, {_ORDER_SQL} AS rank FROM last{_K}), "
    f"n AS (SELECT x.l_orderkey, x.l_linenumber, rank, [{', '.join(_distance_sql('c', j * DIM) for j in range(_K))}] AS ds FROM x, o) "
    "SELECT l_orderkey, l_linenumber, CAST(rank[list_position(ds, list_min(ds))] AS INTEGER) AS cluster FROM n",
)
def _kmeans_labels(spark, d):
    return kmeans_labels(_zrows(spark, d), FEATURES, k=_K, seed=SEED, key="row_key").select("l_orderkey", "l_linenumber", "cluster")


def _axis_sql(name: str, source: str) -> str:
    """CTE with the unit vector ``v`` of the largest eigenvalue of ``source``
    (list ``m``, row by row): the matrix is squared until one axis is left."""
    d, cells = DIM, range(DIM * DIM)
    square = ", ".join(" + ".join(f"m[{i // d * d + k + 1}] * m[{k * d + i % d + 1}]" for k in range(d)) for i in cells)
    trace = " + ".join(f"m[{i * d + i + 1}]" for i in range(d))
    column = f"[{', '.join(f'm[{i} * {d} + b]' for i in range(d))}]"
    return (f"{name}_p AS (SELECT 0 AS it, m FROM {source} UNION ALL SELECT it + 1, list_transform(sq, lambda q: q / tr) FROM "
            f"(SELECT it, [{square}] AS sq, ({trace}) * ({trace}) AS tr FROM {name}_p WHERE it < 50)), "
            f"{name}_c AS (SELECT {column} AS u FROM (SELECT m, list_position([{', '.join(f'm[{i * d + i + 1}]' for i in range(d))}], "
            f"greatest({', '.join(f'm[{i * d + i + 1}]' for i in range(d))})) AS b FROM {name}_p WHERE it = 50)), "
            f"{name} AS MATERIALIZED (SELECT list_transform(u, lambda q: q / sqrt(list_sum(list_transform(u, lambda w: w * w))) * "
            f"sign(u[list_position(list_transform(u, lambda w: abs(w)), list_max(list_transform(u, lambda w: abs(w))))])) AS v FROM {name}_c)")


_COV_SQL = "cov AS MATERIALIZED (SELECT [" + ", ".join(
    f"CAST(sum(CAST(x{i} AS HUGEINT) * x{j}) AS DOUBLE) / count(*) - (CAST(sum(x{i}) AS DOUBLE) / count(*)) * (CAST(sum(x{j}) AS DOUBLE) / count(*))"
    for i in range(DIM) for j in range(DIM)) + "] AS m, [" + ", ".join(f"CAST(sum(x{i}) AS DOUBLE) / count(*)" for i in range(DIM)) + "] AS mean FROM x)"
_VALUE_SQL = " + ".join(f"v[{i + 1}] * m[{i * DIM + j + 1}] * v[{j + 1}]" for i in range(DIM) for j in range(DIM))
_REST_SQL = ", ".join(f"m[{i * DIM + j + 1}] - e * v[{i + 1}] * v[{j + 1}]" for i in range(DIM) for j in range(DIM))


@register(
    "pca2",
    f"WITH RECURSIVE {_POINTS_SQL}, {_COV_SQL}, {_axis_sql('a1', 'cov')}, "
    f"rest AS MATERIALIZED (SELECT [{_REST_SQL}] AS m FROM (SELECT m, v, {_VALUE_SQL} AS e FROM cov, a1)), {_axis_sql('a2', 'rest')} "
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round(({' + '.join(f'(x{i} - mean[{i + 1}]) * {a}.v[{i + 1}]' for i in range(DIM))}) / {_G}, 6) AS {n}"
        for a, n in (("a1", "PC1"), ("a2", "PC2"))) + " FROM x, cov, a1, a2",
)
def _pca2(spark, d):
    return rounded(pca2(_zrows(spark, d), FEATURES).select("l_orderkey", "l_linenumber", "PC1", "PC2"), 6)
