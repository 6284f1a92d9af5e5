"""Dimension build, encode, fact build, joins and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonestats.operators.clean import semi_filter
from zonestats.operators.dims import (
    append_rows,
    apply_overrides,
    dim_build,
    dim_encode,
    fact_build,
)
from zonestats.operators.joins import join_null_safe, left_join_keys
from zonestats.operators.quality import (
    audit_keys,
    has_values,
    missing_keys,
    profile_columns,
    table_shape,
)
from zonestats.plans.registry import register
from zonestats.plans.reports_clean import RAW_TS_DUCKDB_FORMAT, RAW_TS_WRITE_FORMAT, _doc_labels
from zonestats.plans.standins import VIEW_SQL, DriverTables, driver_view, towns
from zonestats.plans.star import SHORT_LABELS as L

V = f"WITH v AS ({VIEW_SQL})"


@register("dim_build",
          "SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS id_brand "
          "FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)")
def _dim_build(spark, d):
    return dim_build(DriverTables(spark, d)["part"], ["p_brand"], "id_brand")


@register("dim_encode",
          "WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS id_brand "
          "FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)), "
          "t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS id_type "
          "FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)) "
          "SELECT p.p_partkey, p.p_size, b.id_brand, t.id_type FROM part p "
          "LEFT JOIN b ON p.p_brand = b.p_brand LEFT JOIN t ON p.p_type = t.p_type")
def _dim_encode(spark, d):
    part = DriverTables(spark, d)["part"]
    brands = dim_build(part, ["p_brand"], "id_brand")
    types = dim_build(part, ["p_type"], "id_type")
    src = part.select("p_partkey", "p_size", "p_brand", "p_type")
    return dim_encode(src, [(brands, ["p_brand"], "id_brand"), (types, ["p_type"], "id_type")])


@register("fact_build",
          "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, "
          f"strptime(strftime(l_shipdate, '{RAW_TS_DUCKDB_FORMAT}'), '{RAW_TS_DUCKDB_FORMAT}') AS shipped "
          "FROM lineitem")
def _fact_build(spark, d):
    li = DriverTables(spark, d)["lineitem"]
    raw = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
                    "l_linestatus", F.date_format("l_shipdate", RAW_TS_WRITE_FORMAT).alias("shipped"))
    return fact_build(raw, "shipped", drop=["l_returnflag", "l_linestatus"])


_Q_DIM = ("SELECT quality, row_number() OVER (ORDER BY quality NULLS LAST) AS id_quality "
          "FROM (SELECT DISTINCT l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


@register("join_null_safe",
          "WITH dl AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l "
          f"ON d.doc_id = l.doc_id), q AS ({_Q_DIM}) "
          "SELECT dl.doc_id, dl.quality, q.id_quality FROM dl LEFT JOIN q "
          "ON dl.quality IS NOT DISTINCT FROM q.quality")
def _join_null_safe(spark, d):
    dl = _doc_labels(spark, d).select("doc_id", "quality")
    q = dim_build(dl, ["quality"], "id_quality", dropna=False)
    return join_null_safe(dl, q, ["quality"])


@register("left_join_keys",
          "SELECT o.o_orderkey, o.o_custkey, c.c_custkey, c.c_name FROM orders o "
          "LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def _left_join_keys(spark, d):
    t = DriverTables(spark, d)
    o = t["orders"].select("o_orderkey", "o_custkey")
    c = t["customer"].select("c_custkey", "c_name")
    return left_join_keys(o, c, ["o_custkey"], ["c_custkey"])


@register("semi_filter",
          "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN "
          "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _semi_filter(spark, d):
    t = DriverTables(spark, d)
    keys = t["orders"].where(F.col("o_orderstatus") == "F")
    li = t["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity")
    return semi_filter(li, keys, "l_orderkey", "o_orderkey")


@register("missing_keys",
          "SELECT DISTINCT doc_id, lang, source FROM documents d "
          "WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _missing_keys(spark, d):
    t = DriverTables(spark, d)
    return missing_keys(t["documents"], t["labels"], "doc_id", cols=["doc_id", "lang", "source"])


@register("audit_keys",
          "SELECT 'duplicate_pk' AS \"check\", CAST(l_orderkey AS VARCHAR) || '|' || "
          "CAST(l_linenumber AS VARCHAR) AS key, count(*) AS n FROM lineitem "
          "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 "
          "UNION ALL SELECT 'fk:l_partkey', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem "
          "WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part "
          "WHERE p_partkey IS NOT NULL) GROUP BY l_partkey "
          "UNION ALL SELECT 'fk:l_suppkey', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem "
          "WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier "
          "WHERE s_suppkey IS NOT NULL) GROUP BY l_suppkey "
          "UNION ALL SELECT 'fk:l_orderkey', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem "
          "WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders "
          "WHERE o_orderkey IS NOT NULL) GROUP BY l_orderkey")
def _audit_keys(spark, d):
    t = DriverTables(spark, d)
    return audit_keys(t["lineitem"], ["l_orderkey", "l_linenumber"], {
        "l_partkey": (t["part"], "p_partkey"),
        "l_suppkey": (t["supplier"], "s_suppkey"),
        "l_orderkey": (t["orders"], "o_orderkey"),
    })


@register("profile_columns",
          "WITH x AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d "
          "LEFT JOIN labels l ON d.doc_id = l.doc_id) "
          "SELECT 0 AS position, 'doc_id' AS \"column\", 'bigint' AS dtype, count(doc_id) AS non_null FROM x "
          "UNION ALL SELECT 1, 'lang', 'string', count(lang) FROM x "
          "UNION ALL SELECT 2, 'source', 'string', count(source) FROM x "
          "UNION ALL SELECT 3, 'quality', 'int', count(quality) FROM x "
          "UNION ALL SELECT 4, 'toxic', 'int', count(toxic) FROM x")
def _profile_columns(spark, d):
    return profile_columns(_doc_labels(spark, d))


@register("table_shape",
          "SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_cols FROM lineitem")
def _table_shape(spark, d):
    return table_shape(DriverTables(spark, d)["lineitem"])


@register("has_values",
          f"{V} SELECT town_id, count(lat) > 0 AND count(lon) > 0 AS has_values FROM v GROUP BY town_id")
def _has_values(spark, d):
    return has_values(driver_view(spark, d), [L.lat, L.lon], keys=[L.town_id])


# Fixed value: one inserted town with only three known columns (the rest NULL).
INSERTED_TOWN = {"id_centro_poblado": -1, "centro_poblado": "INSERTED TOWN", "id_municipio": 0}


@register("append_rows",
          "SELECT c.c_custkey AS id_centro_poblado, c.c_name AS centro_poblado, "
          "c.c_nationkey AS id_municipio, CAST(n.n_regionkey AS DOUBLE) AS longitud, "
          "CAST(n.n_nationkey AS DOUBLE) AS latitud, c.c_mktsegment AS clase "
          "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
          "UNION ALL SELECT -1, 'INSERTED TOWN', 0, NULL, NULL, NULL")
def _append_rows(spark, d):
    return append_rows(towns(DriverTables(spark, d)), [INSERTED_TOWN])


# Fixed value: four keyed name corrections.
NAME_FIXES = [(7, "FIXED NAME 7"), (11, "FIXED NAME 11"), (19, "FIXED NAME 19"), (23, "FIXED NAME 23")]


@register("apply_overrides",
          "SELECT c.c_custkey, coalesce(f.name, c.c_name) AS c_name, c.c_nationkey FROM customer c "
          "LEFT JOIN (VALUES (7, 'FIXED NAME 7'), (11, 'FIXED NAME 11'), (19, 'FIXED NAME 19'), "
          "(23, 'FIXED NAME 23')) f(key, name) ON c.c_custkey = f.key")
def _apply_overrides(spark, d):
    c = DriverTables(spark, d)["customer"].select("c_custkey", "c_name", "c_nationkey")
    fixes = spark.createDataFrame(NAME_FIXES, "c_custkey bigint, c_name string")
    return apply_overrides(c, fixes, "c_custkey", "c_name")
