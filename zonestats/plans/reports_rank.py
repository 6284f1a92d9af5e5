"""Star view, power factor and the ranking reports (levels 1-3)."""

from __future__ import annotations


from zonestats.operators.rank import head_n, rank_by, rank_levels, share_of_total, tail_n, top_k
from zonestats.plans.registry import register, rounded
from zonestats.functions.columns import power_factor
from zonestats.plans.standins import VIEW_SQL, DriverTables, driver_view, services
from zonestats.plans.star import SHORT_LABELS as L

V = f"WITH v AS ({VIEW_SQL})"
LEVEL_KEYS = L.level_keys

register(
    "star_view",
    f"{V} SELECT dept_id, dept_name, muni_id, muni_name, town_id, town_name, lat, lon, "
    "round(active_energy, 4) AS active_energy, round(reactive_energy, 4) AS reactive_energy, "
    "round(power_factor, 9) AS power_factor, max_power, peak_ts, "
    "round(daily_hours, 6) AS daily_hours, population, round(need_pct, 6) AS need_pct, "
    "services_pct FROM v",
)(lambda spark, d: rounded(driver_view(spark, d), 6, {
    L.active: 4, L.reactive: 4, L.pf: 9, L.population: 2}))


@register(
    "power_factor",
    "SELECT l.l_orderkey AS id_servicio_order, l.l_linenumber AS id_servicio_line, "
    "round(l.l_extendedprice / NULLIF(SQRT(POWER(l.l_extendedprice, 2) "
    "+ POWER(o.o_totalprice * l.l_tax, 2)), 0), 9) AS power_factor "
    "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
)
def _power_factor(spark, d):
    s = services(DriverTables(spark, d))
    out = s.select("id_servicio_order", "id_servicio_line",
                   power_factor("energia_activa", "energia_reactiva").alias("power_factor"))
    return rounded(out, 9)


# The mean rankings: 4 measures x 3 levels (AG4-AG7). Each measure is
# fixed-point (money with 2 decimals, a product of two such values with 4),
# so sums run exactly and both engines give the same bits.
_MEANS = {
    "active": (L.active, 2),
    "reactive": (L.reactive, 4),
    "power": (L.power, 2),
    "hours": (L.hours, 2),
}


def _keys_sql(level: int) -> str:
    return ", ".join(LEVEL_KEYS[level])


def _not_null_sql(level: int) -> str:
    return " AND ".join(f"{k} IS NOT NULL" for k in LEVEL_KEYS[level])


def exact_sum_sql(col: str, scale: int) -> str:
    return f"CAST(sum(CAST({col} AS DECIMAL(18, {scale}))) AS DOUBLE)"


def _mean_query(measure: str, level: int, scale: int):
    def q(spark, d):
        v = driver_view(spark, d)
        return rank_by(v, LEVEL_KEYS[level], measure, "avg", scale=scale)
    return q


for _name, (_measure, _scale) in _MEANS.items():
    for _level in (1, 2, 3):
        register(
            f"rank_mean_{_name}_l{_level}",
            f"{V} SELECT {_keys_sql(_level)}, "
            f"{exact_sum_sql(_measure, _scale)} / count({_measure}) AS {_measure} "
            f"FROM v WHERE {_not_null_sql(_level)} GROUP BY {_keys_sql(_level)}",
        )(_mean_query(_measure, _level, _scale))


# Distinct towns per department / municipality (AG1).
def _nunique_query(level: int):
    def q(spark, d):
        v = driver_view(spark, d)
        return rank_by(v, LEVEL_KEYS[level], L.town_name, "nunique", out="n_towns")
    return q


for _level in (1, 2):
    register(
        f"rank_nunique_l{_level}",
        f"{V} SELECT {_keys_sql(_level)}, count(DISTINCT town_name) AS n_towns "
        f"FROM v WHERE {_not_null_sql(_level)} GROUP BY {_keys_sql(_level)}",
    )(_nunique_query(_level))


# Population (AG2) and people-in-need (AG3) sums, summed over service rows.
def _sum_query(measure: str, level: int, out: str, scale: int):
    def q(spark, d):
        v = driver_view(spark, d)
        return rank_by(v, LEVEL_KEYS[level], measure, "sum", out=out, scale=scale)
    return q


for _level in (1, 2, 3):
    register(
        f"rank_sum_l{_level}",
        f"{V} SELECT {_keys_sql(_level)}, coalesce({exact_sum_sql('population', 2)}, 0) AS population "
        f"FROM v WHERE {_not_null_sql(_level)} GROUP BY {_keys_sql(_level)}",
    )(_sum_query(L.population, _level, L.population, 2))
    register(
        f"rank_sum_need_l{_level}",
        f"{V} SELECT {_keys_sql(_level)}, coalesce({exact_sum_sql('need_pct', 4)}, 0) AS people_in_need "
        f"FROM v WHERE {_not_null_sql(_level)} GROUP BY {_keys_sql(_level)}",
    )(_sum_query(L.need, _level, "people_in_need", 4))


@register(
    "rank_sum_dedup_l2",
    f"{V}, t AS (SELECT dept_name, muni_name, town_id, max(population) AS population FROM v "
    "WHERE dept_name IS NOT NULL AND muni_name IS NOT NULL GROUP BY dept_name, muni_name, town_id) "
    f"SELECT dept_name, muni_name, coalesce({exact_sum_sql('population', 2)}, 0) AS population "
    "FROM t GROUP BY dept_name, muni_name",
)
def _rank_sum_dedup(spark, d):
    v = driver_view(spark, d)
    return rank_by(v, LEVEL_KEYS[2], L.population, "sum", dedupe_on=[L.town_id], scale=2)


# All three levels at once (AG1, AG4 and the deduplicated AG2), with one scan.
def _levels_sql(result: str) -> str:
    def one(level: int) -> str:
        keys = [k if k in LEVEL_KEYS[level] else f"NULL AS {k}" for k in LEVEL_KEYS[3]]
        return (f"SELECT {level} AS level, {', '.join(keys)}, {result} FROM v "
                f"WHERE {_not_null_sql(level)} GROUP BY {_keys_sql(level)}")
    return " UNION ALL ".join(map(one, (1, 2, 3)))


def _levels(spark, d, *args, **kwargs):
    return rank_levels(driver_view(spark, d), [LEVEL_KEYS[i] for i in (1, 2, 3)], *args, **kwargs)


register(
    "rank_levels_mean_active",
    f"{V} {_levels_sql(exact_sum_sql('active_energy', 2) + ' / count(active_energy) AS active_energy')}",
)(lambda spark, d: _levels(spark, d, L.active, "avg", scale=2))
register(
    "rank_levels_nunique",
    f"{V} {_levels_sql('count(DISTINCT town_name) AS n_towns')}",
)(lambda spark, d: _levels(spark, d, L.town_name, "nunique", out="n_towns"))


def _dedup_sql(level: int) -> str:
    keys = [k if k in LEVEL_KEYS[level] else f"NULL AS {k}" for k in LEVEL_KEYS[3]]
    return (f"SELECT {level} AS level, {', '.join(keys)}, coalesce({exact_sum_sql('population', 2)}, 0) AS population "
            f"FROM (SELECT {_keys_sql(level)}, town_id, max(population) AS population FROM v "
            f"WHERE {_not_null_sql(level)} GROUP BY {_keys_sql(level)}, town_id) GROUP BY {_keys_sql(level)}")


register(
    "rank_levels_population",
    f"{V} {' UNION ALL '.join(map(_dedup_sql, (1, 2, 3)))}",
)(lambda spark, d: _levels(spark, d, L.population, "sum", dedupe_on=[L.town_id], scale=2))


@register(
    "share_of_total",
    f"{V}, g AS (SELECT muni_name, sum(CAST(active_energy AS DECIMAL(18, 2))) AS s FROM v "
    "WHERE muni_name IS NOT NULL GROUP BY muni_name) "
    "SELECT muni_name, CAST(s AS DOUBLE) AS active_energy, "
    "CAST(s AS DOUBLE) / NULLIF((SELECT CAST(sum(s) AS DOUBLE) FROM g), 0) * 100 AS share_pct FROM g",
)
def _share_of_total(spark, d):
    v = driver_view(spark, d)
    return share_of_total(v, [L.muni_name], L.active, scale=2)


@register(
    "top_k",
    f"{V} SELECT dept_name, muni_name, town_name, coalesce({exact_sum_sql('active_energy', 2)}, 0) "
    "AS active_energy "
    "FROM v WHERE dept_name IS NOT NULL AND muni_name IS NOT NULL AND town_name IS NOT NULL "
    "GROUP BY dept_name, muni_name, town_name "
    "ORDER BY active_energy DESC NULLS LAST, dept_name, muni_name, town_name LIMIT 10",
)
def _top_k(spark, d):
    v = driver_view(spark, d)
    return top_k(v, LEVEL_KEYS[3], L.active, 10, fn="sum", scale=2)


@register(
    "head_n",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem "
    "ORDER BY l_orderkey, l_linenumber, l_extendedprice LIMIT 10",
)
def _head_n(spark, d):
    li = DriverTables(spark, d)["lineitem"]
    return head_n(li.select("l_orderkey", "l_linenumber", "l_extendedprice"),
                  ["l_orderkey", "l_linenumber", "l_extendedprice"], 10)


@register(
    "tail_n",
    "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem "
    "ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC LIMIT 10) "
    "ORDER BY l_orderkey, l_linenumber, l_extendedprice",
)
def _tail_n(spark, d):
    li = DriverTables(spark, d)["lineitem"]
    return tail_n(li.select("l_orderkey", "l_linenumber", "l_extendedprice"),
                  ["l_orderkey", "l_linenumber", "l_extendedprice"], 10)
