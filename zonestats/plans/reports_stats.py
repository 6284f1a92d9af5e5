"""Per-town selection, map, statistics and distribution reports.

Per-town statistics run for every town at once (``events`` with
``user_id`` as the town and ``value`` as the measure, 2 decimals).
"""

from __future__ import annotations

from zonestats.operators.dist import frequency_table, kde
from zonestats.operators.geo import map_aggregate, map_measures, map_view_point
from zonestats.operators.lookup import (
    child_options,
    lookup_id,
    lookup_id_sql,
    lookup_ids,
    time_series,
    time_series_mean,
)
from zonestats.operators.stats import (
    box_stats,
    centre_stats,
    mode_all,
    position_stats,
    shape_stats,
    spread_stats,
)
from zonestats.plans.registry import register, rounded
from zonestats.plans.standins import VIEW_SQL, DriverTables, driver_view
from zonestats.plans.star import SHORT_LABELS as L

V = f"WITH v AS ({VIEW_SQL})"


def _events(spark, d):
    return DriverTables(spark, d)["events"]


# ---- selection ----------------------------------------------------------------

@register("lookup_id",
          f"{V} SELECT min(muni_id) AS muni_id FROM v WHERE muni_name = 'NATION_7' AND dept_id = 2")
def _lookup_id(spark, d):
    return lookup_id(driver_view(spark, d), L.muni_id, L.muni_name, "NATION_7",
                     scope={L.dept_id: 2})


@register("lookup_id_sql",
          f"{V} SELECT min(town_id) AS result FROM v WHERE town_name = 'Customer#000000042'")
def _lookup_id_sql(spark, d):
    """The lookup as parameterised SQL over a session view of the star view:
    table, columns and value are bound parameters, not pasted text."""
    driver_view(spark, d).createOrReplaceTempView("service_view")
    return lookup_id_sql(spark, "service_view", L.town_id, L.town_name, "Customer#000000042")


@register("lookup_ids",
          f"{V} SELECT town_name, min(town_id) AS town_id, count(DISTINCT town_id) AS n_codes "
          "FROM v WHERE town_name IS NOT NULL GROUP BY town_name")
def _lookup_ids(spark, d):
    return lookup_ids(driver_view(spark, d), L.town_id, L.town_name)


@register("child_options",
          f"{V} SELECT DISTINCT muni_name FROM v WHERE dept_id = 2")
def _child_options(spark, d):
    return child_options(driver_view(spark, d), L.muni_name, L.dept_id, 2)


@register("time_series",
          "SELECT user_id, ts, value, event_type FROM events")
def _time_series(spark, d):
    return time_series(_events(spark, d), "ts", ["value", "event_type"], key="user_id")


@register("time_series_mean",
          f"{V} SELECT town_id, peak_ts, CAST(sum(CAST(max_power AS DECIMAL(18, 2))) AS DOUBLE) "
          "/ count(max_power) AS max_power FROM v GROUP BY town_id, peak_ts")
def _time_series_mean(spark, d):
    return time_series_mean(driver_view(spark, d), L.ts, L.power, keys=[L.town_id], scale=2)


# ---- map ----------------------------------------------------------------------

_MAP_SQL = (
    f"{V}, g AS (SELECT town_name, median(daily_hours) AS daily_hours, avg(lat) AS lat, "
    "avg(lon) AS lon FROM v WHERE town_name IS NOT NULL GROUP BY town_name), "
    "m AS (SELECT lat, lon, arg_min(town_name, town_name) AS town_name, "
    "arg_min(daily_hours, town_name) AS daily_hours FROM g "
    "WHERE lat IS NOT NULL AND lon IS NOT NULL AND daily_hours IS NOT NULL GROUP BY lat, lon)"
)


@register("map_aggregate",
          f"{_MAP_SQL} SELECT town_name, lat, lon, daily_hours, "
          "daily_hours / (SELECT max(daily_hours) FROM m) * 10000.0 AS elevation_norm FROM m")
def _map_aggregate(spark, d):
    return map_aggregate(driver_view(spark, d), [L.town_name], L.hours, L.lat, L.lon)


@register("map_centre", f"{_MAP_SQL} SELECT avg(lat) AS lat, avg(lon) AS lon FROM m")
def _map_centre(spark, d):
    return map_view_point(driver_view(spark, d), [L.town_name], L.hours, L.lat, L.lon)


MAP_MEASURES = [L.hours, L.active, L.reactive, L.power, L.population, L.need, L.services]


def _map_measure_sql(measure: str) -> str:
    return (f"SELECT '{measure}' AS measure, lat, lon, min(town_name) AS town_name, arg_min(value, town_name) AS value "
            f"FROM (SELECT town_name, median({measure}) AS value, avg(lat) AS lat, avg(lon) AS lon FROM v "
            "WHERE town_name IS NOT NULL GROUP BY town_name) "
            "WHERE lat IS NOT NULL AND lon IS NOT NULL AND value IS NOT NULL GROUP BY lat, lon")


@register("map_measures",
          f"{V}, m AS ({' UNION ALL '.join(map(_map_measure_sql, MAP_MEASURES))}) "
          "SELECT measure, town_name, lat, lon, round(value, 6) AS value, "
          "round(value / NULLIF(max(value) OVER (PARTITION BY measure), 0) * 10000.0, 6) AS elevation_norm FROM m")
def _map_measures(spark, d):
    m = map_measures(driver_view(spark, d), [L.town_name], MAP_MEASURES, L.lat, L.lon)
    return rounded(m, 6, {"lat": None, "lon": None})


# ---- statistics per town -------------------------------------------------------

_MEAN_SQL = "CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value)"
_MODES_SQL = ("c AS (SELECT user_id, value, count(*) AS n FROM events WHERE value IS NOT NULL "
              "GROUP BY user_id, value), "
              "modes AS (SELECT c.user_id, c.value AS mode FROM c JOIN "
              "(SELECT user_id, max(n) AS top FROM c GROUP BY user_id) t "
              "ON c.user_id = t.user_id AND c.n = t.top)")


@register("mode_all", f"WITH {_MODES_SQL} SELECT user_id, mode FROM modes")
def _mode_all(spark, d):
    return mode_all(_events(spark, d), "value", ["user_id"])


@register("centre_stats",
          f"WITH {_MODES_SQL}, s AS (SELECT user_id, {_MEAN_SQL} AS mean, median(value) AS median "
          "FROM events GROUP BY user_id) "
          "SELECT modes.user_id, s.mean, s.median, modes.mode FROM modes JOIN s "
          "ON modes.user_id = s.user_id")
def _centre_stats(spark, d):
    return centre_stats(_events(spark, d), "value", ["user_id"], scale=2)


@register("spread_stats",
          f"SELECT user_id, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, "
          "round(var_samp(value), 6) AS variance, round_even(stddev_samp(value) * 100, 0) / 100 AS std, "
          "round_even((round_even(stddev_samp(value) * 100, 0) / 100) / "
          f"NULLIF({_MEAN_SQL}, 0) * 100 * 100, 0) / 100 AS cv "
          "FROM events GROUP BY user_id")
def _spread_stats(spark, d):
    return rounded(spread_stats(_events(spark, d), "value", ["user_id"], scale=2), None,
                   per_column={"variance": 6})


@register("shape_stats",
          "SELECT user_id, round(CASE WHEN count(value) < 3 THEN NULL WHEN var_pop(value) = 0 THEN 0 "
          "ELSE skewness(value) END, 9) AS skewness, "
          "round(CASE WHEN count(value) < 4 THEN NULL WHEN var_pop(value) = 0 THEN 0 "
          "ELSE kurtosis(value) END, 9) AS kurtosis FROM events GROUP BY user_id")
def _shape_stats(spark, d):
    return rounded(shape_stats(_events(spark, d), "value", ["user_id"]), 9)


# Quartiles with numpy's linear interpolation written out over explicit ranks.
_RANKS_SQL = ("r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 "
              "AS rk, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)")


def _q_sql(p: float, name: str) -> str:
    h = f"((n - 1) * {p})"
    lo = f"max(CASE WHEN rk = floor({h}) THEN value END)"
    hi = f"max(CASE WHEN rk = ceil({h}) THEN value END)"
    t = f"max({h} - floor({h}))"
    return (f"CASE WHEN {t} >= 0.5 THEN {hi} - ({hi} - {lo}) * (1 - {t}) "
            f"ELSE {lo} + ({hi} - {lo}) * {t} END AS {name}")


_QUARTILES_SQL = (f"q AS (SELECT user_id, {_q_sql(0.25, 'q1')}, {_q_sql(0.5, 'q2')}, "
                  f"{_q_sql(0.75, 'q3')} FROM r GROUP BY user_id)")


@register("position_stats",
          f"WITH {_RANKS_SQL}, {_QUARTILES_SQL} SELECT user_id, q1, q2, q3, q3 - q1 AS iqr, "
          "q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q")
def _position_stats(spark, d):
    return position_stats(_events(spark, d), "value", ["user_id"])


@register("box_stats",
          f"WITH {_RANKS_SQL}, {_QUARTILES_SQL}, f AS (SELECT user_id, q1, q2, q3, "
          "q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "
          "SELECT f.user_id, f.q1, f.q2 AS median, f.q3, "
          "min(CASE WHEN e.value >= f.lo AND e.value <= f.hi THEN e.value END) AS lower_whisker, "
          "max(CASE WHEN e.value >= f.lo AND e.value <= f.hi THEN e.value END) AS upper_whisker, "
          "count(CASE WHEN NOT (e.value >= f.lo AND e.value <= f.hi) THEN 1 END) AS n_outliers "
          "FROM events e JOIN f ON e.user_id = f.user_id WHERE e.value IS NOT NULL "
          "GROUP BY f.user_id, f.q1, f.q2, f.q3")
def _box_stats(spark, d):
    return box_stats(_events(spark, d), "value", ["user_id"])


# ---- distributions --------------------------------------------------------------

def _round_frac_sql(x: str, p: str = "3") -> str:
    d = (f"CAST(CASE WHEN trunc({x}) = 0 THEN -floor(log10(abs({x} - trunc({x})))) - 1 + {p} "
         f"ELSE {p} END AS INTEGER)")
    return (f"CASE WHEN {x} = 0 THEN {x} ELSE round_even({x} * pow(10.0, {d}), 0) / pow(10.0, {d}) END")


def _prec_sql(edges: str) -> str:
    conds = " ".join(
        f"WHEN len(list_distinct(list_transform({edges}, lambda q: {_round_frac_sql('q', str(p))}))) "
        f"= len({edges}) THEN {p}" for p in range(3, 20))
    return f"CASE {conds} ELSE 3 END"


_FREQ_SQL = (
    "WITH g AS (SELECT user_id, count(*) AS n_all, count(value) AS n, min(value) AS mn, "
    "max(value) AS mx FROM events GROUP BY user_id), "
    "p AS (SELECT *, CAST(floor(log2(n_all + 1)) AS INTEGER) AS bins, "
    "CASE WHEN mn = mx THEN mn - CASE WHEN mn <> 0 THEN 0.001 * abs(mn) ELSE 0.001 END ELSE mn END AS st, "
    "CASE WHEN mn = mx THEN mx + CASE WHEN mx <> 0 THEN 0.001 * abs(mx) ELSE 0.001 END ELSE mx END AS sp "
    "FROM g WHERE n > 0), "
    "e AS (SELECT user_id, n, bins, list_transform(range(0, bins + 1), lambda i: CASE "
    "WHEN i = 0 THEN (CASE WHEN mn = mx THEN st ELSE st - (sp - st) * 0.001 END) "
    "WHEN i = bins THEN sp ELSE CAST(i AS DOUBLE) * ((sp - st) / bins) + st END) AS edges "
    "FROM p WHERE bins > 0), "
    "c AS (SELECT ev.user_id, len(list_filter(e.edges, lambda x: x < ev.value)) AS class, count(*) AS freq "
    "FROM events ev JOIN e ON ev.user_id = e.user_id WHERE ev.value IS NOT NULL GROUP BY 1, 2), "
    f"k AS (SELECT user_id, n, edges, {_prec_sql('edges')} AS prec, "
    "unnest(range(1, bins + 1)) AS class FROM e), "
    "t AS (SELECT k.user_id, CAST(k.class AS INTEGER) AS class, k.edges[k.class] AS lower, "
    "k.edges[k.class + 1] AS upper, coalesce(c.freq, 0) AS freq, k.n, k.prec FROM k "
    "LEFT JOIN c ON k.user_id = c.user_id AND k.class = c.class) "
)


@register("frequency_table",
          f"{_FREQ_SQL} SELECT user_id, class, lower, upper, "
          f"'(' || CAST({_round_frac_sql('lower', 'prec')} AS VARCHAR) || ', ' || "
          f"CAST({_round_frac_sql('upper', 'prec')} AS VARCHAR) || ']' AS interval, freq, "
          "CAST(sum(freq) OVER (PARTITION BY user_id ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING "
          "AND CURRENT ROW) AS BIGINT) AS cum_freq, round(freq / n * 100.0, 9) AS rel_freq, "
          "round(sum(freq / n * 100.0) OVER (PARTITION BY user_id ORDER BY class ROWS BETWEEN "
          "UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS cum_rel_freq FROM t")
def _frequency_table(spark, d):
    return rounded(frequency_table(_events(spark, d), "value", ["user_id"]), None,
                   {"rel_freq": 9, "cum_rel_freq": 9})


@register("kde",
          "WITH s AS (SELECT count(value) AS n, 0.1 * stddev_samp(value) AS h, min(value) AS mn, "
          "max(value) AS mx FROM events WHERE value IS NOT NULL), "
          "c AS (SELECT value, count(*) AS w FROM events WHERE value IS NOT NULL GROUP BY value), "
          "gp AS (SELECT i AS point, CASE WHEN i = 999 THEN mx ELSE CAST(i AS DOUBLE) * ((mx - mn) / 999.0) "
          "+ mn END AS x FROM s, range(0, 1000) r(i)) "
          "SELECT gp.point, gp.x, round(sum(c.w * exp(-0.5 * ((gp.x - c.value) / s.h) * ((gp.x - c.value) "
          "/ s.h))) / (s.n * s.h * sqrt(2 * pi())), 12) AS density "
          "FROM gp, c, s WHERE s.h > 0 GROUP BY gp.point, gp.x, s.n, s.h")
def _kde(spark, d):
    return rounded(kde(_events(spark, d), "value"), None, {"density": 12})


@register("kde_by_type",
          "WITH s AS (SELECT event_type, count(value) AS n, 0.1 * stddev_samp(value) AS h, min(value) AS mn, "
          "max(value) AS mx FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type), "
          "c AS (SELECT event_type, value, count(*) AS w FROM events WHERE value IS NOT NULL GROUP BY ALL), "
          "gp AS (SELECT event_type, n, h, i AS point, CASE WHEN i = 999 THEN mx ELSE CAST(i AS DOUBLE) * "
          "((mx - mn) / 999.0) + mn END AS x FROM s, range(0, 1000) r(i) WHERE h > 0) "
          "SELECT event_type, CAST(point AS INTEGER) AS point, x, round(sum(w * exp(-0.5 * ((x - value) / h) * "
          "((x - value) / h))) / (n * h * sqrt(2 * pi())), 10) AS density "
          "FROM gp JOIN c USING (event_type) GROUP BY event_type, point, x, n, h")
def _kde_by_type(spark, d):
    return rounded(kde(_events(spark, d), "value", ["event_type"]), None, {"density": 10})
