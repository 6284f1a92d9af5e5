"""Projection, cast, recode, filter and row-set reports (cleaning job)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonestats.operators.clean import (
    distinct_first,
    distinct_rows,
    drop_columns,
    dropna_any,
    filter_eq,
    float_to_int,
    null_rows,
    parse_timestamp,
    recode,
    rename_columns,
    select_columns,
    strict_int_cast,
    unpivot_pair,
    with_complement,
    with_day_name,
)
from zonestats.operators.rank import share_of_total
from zonestats.plans.registry import register
from zonestats.plans.standins import VIEW_SQL, DriverTables, census, driver_view, towns
from zonestats.plans.star import SHORT_LABELS as L

V = f"WITH v AS ({VIEW_SQL})"

# Fixed value: the text layout of the raw timestamps (two-digit fields).
RAW_TS_WRITE_FORMAT = "MM/dd/yyyy hh:mm:ss a"
RAW_TS_DUCKDB_FORMAT = "%m/%d/%Y %I:%M:%S %p"


@register("select_columns",
          "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def _select_columns(spark, d):
    li = DriverTables(spark, d)["lineitem"]
    return select_columns(li, ["l_orderkey", "l_partkey", "l_quantity", "l_partkey"])


@register("drop_columns",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _drop_columns(spark, d):
    o = DriverTables(spark, d)["orders"]
    return drop_columns(o, ["o_orderdate", "o_orderpriority"])


@register("rename_columns",
          "SELECT c_custkey AS id_centro_poblado, c_name AS centro_poblado, "
          "c_nationkey AS id_municipio FROM customer")
def _rename_columns(spark, d):
    c = DriverTables(spark, d)["customer"].select("c_custkey", "c_name", "c_nationkey")
    return rename_columns(c, {"c_custkey": "id_centro_poblado", "c_name": "centro_poblado",
                              "c_nationkey": "id_municipio"})


_CENSUS_SQL = ("SELECT c_custkey AS id_centro_poblado, ABS(c_acctbal) / 100.0 AS personas_nbi, "
               "CAST(c_nationkey AS DOUBLE) * 4.0 AS servicios FROM customer")


@register("complement_pct",
          f"WITH n AS ({_CENSUS_SQL}) SELECT id_centro_poblado, personas_nbi, "
          "100.0 - personas_nbi AS sin_nbi, servicios, 100.0 - servicios AS con_servicios FROM n")
def _complement_pct(spark, d):
    n = census(DriverTables(spark, d)).select("id_centro_poblado", "personas_nbi", "servicios")
    n = with_complement(n, "personas_nbi", "sin_nbi")
    n = with_complement(n, "servicios", "con_servicios")
    return n.select("id_centro_poblado", "personas_nbi", "sin_nbi", "servicios", "con_servicios")


@register("strict_int_cast",
          "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem")
def _strict_int_cast(spark, d):
    li = DriverTables(spark, d)["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity")
    return strict_int_cast(li, ["l_quantity"], "int")


@register("float_to_int",
          "SELECT c.c_custkey AS id_centro_poblado, c.c_name AS centro_poblado, "
          "c.c_nationkey AS id_municipio, CAST(n.n_regionkey AS BIGINT) AS longitud, "
          "CAST(n.n_nationkey AS BIGINT) AS latitud, c.c_mktsegment AS clase "
          "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def _float_to_int(spark, d):
    return float_to_int(towns(DriverTables(spark, d)))


# Fixed value: order status recode used on the driver tables (P has no code).
STATUS_CODES = {"F": 1, "O": 2}


@register("recode",
          "SELECT o_orderkey, o_orderstatus, "
          "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status_code FROM orders")
def _recode(spark, d):
    o = DriverTables(spark, d)["orders"].select("o_orderkey", "o_orderstatus")
    return recode(o, "o_orderstatus", STATUS_CODES, out="status_code", value_type="int")


@register("parse_timestamp",
          f"SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '{RAW_TS_DUCKDB_FORMAT}') AS ship_text, "
          f"strptime(strftime(l_shipdate, '{RAW_TS_DUCKDB_FORMAT}'), '{RAW_TS_DUCKDB_FORMAT}') AS shipped "
          "FROM lineitem")
def _parse_timestamp(spark, d):
    li = DriverTables(spark, d)["lineitem"].select(
        "l_orderkey", "l_linenumber",
        F.date_format("l_shipdate", RAW_TS_WRITE_FORMAT).alias("ship_text"))
    return parse_timestamp(li, "ship_text", out="shipped")


@register("day_name",
          "SELECT l_orderkey, l_linenumber, l_shipdate, dayname(l_shipdate) AS day_name FROM lineitem")
def _day_name(spark, d):
    li = DriverTables(spark, d)["lineitem"].select("l_orderkey", "l_linenumber", "l_shipdate")
    return with_day_name(li, "l_shipdate")


_PAIR_SQL = (f"WITH n AS ({_CENSUS_SQL}), p AS ("
             "SELECT id_centro_poblado, 'personas_nbi' AS condition, personas_nbi AS amount FROM n "
             "UNION ALL SELECT id_centro_poblado, 'sin_nbi' AS condition, 100.0 - personas_nbi AS amount "
             "FROM n)")


def _pairs(spark, d):
    n = census(DriverTables(spark, d)).select("id_centro_poblado", "personas_nbi")
    n = with_complement(n, "personas_nbi", "sin_nbi")
    return unpivot_pair(n, ["personas_nbi", "sin_nbi"], "condition", "amount",
                        ids=["id_centro_poblado"])


register("unpivot_pair", f"{_PAIR_SQL} SELECT * FROM p")(_pairs)


@register("share_pair",
          f"{_PAIR_SQL}, g AS (SELECT condition, sum(CAST(amount AS DECIMAL(18, 4))) AS s FROM p "
          "GROUP BY condition) SELECT condition, CAST(s AS DOUBLE) AS amount, "
          "CAST(s AS DOUBLE) / NULLIF((SELECT CAST(sum(s) AS DOUBLE) FROM g), 0) * 100 AS share_pct FROM g")
def _share_pair(spark, d):
    return share_of_total(_pairs(spark, d), ["condition"], "amount", scale=4)


@register("filter_eq",
          f"{V} SELECT town_id, town_name, peak_ts, active_energy FROM v WHERE dept_name = 'ASIA'")
def _filter_eq(spark, d):
    v = driver_view(spark, d)
    return filter_eq(v, L.dept_name, "ASIA").select(L.town_id, L.town_name, L.ts, L.active)


_DOC_LABELS = ("SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d "
               "LEFT JOIN labels l ON d.doc_id = l.doc_id")


def _doc_labels(spark, d):
    t = DriverTables(spark, d)
    docs = t["documents"].select("doc_id", "lang", "source")
    lab = t["labels"].select(F.col("doc_id").alias("_ld"), "quality", "toxic")
    return docs.join(lab, docs["doc_id"] == lab["_ld"], "left").drop("_ld")


@register("null_rows",
          f"SELECT doc_id, lang, source FROM ({_DOC_LABELS}) WHERE quality IS NULL ORDER BY doc_id")
def _null_rows(spark, d):
    return null_rows(_doc_labels(spark, d), "quality", ["doc_id"]).select("doc_id", "lang", "source")


@register("dropna_any",
          f"SELECT * FROM ({_DOC_LABELS}) WHERE doc_id IS NOT NULL AND lang IS NOT NULL "
          "AND source IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
def _dropna_any(spark, d):
    return dropna_any(_doc_labels(spark, d))


@register("distinct_rows",
          "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def _distinct_rows(spark, d):
    return distinct_rows(DriverTables(spark, d)["customer"].select("c_nationkey", "c_mktsegment"))


@register("distinct_first",
          "SELECT latitud, longitud, arg_min(id_centro_poblado, id_centro_poblado) AS id_centro_poblado, "
          "arg_min(centro_poblado, id_centro_poblado) AS centro_poblado FROM ("
          "SELECT c.c_custkey AS id_centro_poblado, c.c_name AS centro_poblado, "
          "CAST(n.n_nationkey AS DOUBLE) AS latitud, CAST(n.n_regionkey AS DOUBLE) AS longitud "
          "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey) GROUP BY latitud, longitud")
def _distinct_first(spark, d):
    t = towns(DriverTables(spark, d)).select("id_centro_poblado", "centro_poblado", "latitud", "longitud")
    return distinct_first(t, ["latitud", "longitud"], ["id_centro_poblado"])
