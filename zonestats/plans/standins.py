"""Domain tables expressed over the driver's TPC-H-like parquet tables.

The library operators take the domain tables (see ``zonestats.schemas``);
the test/bench data is a TPC-H-like star schema. This module maps one onto
the other with plain projections and joins, so every registered query reads
the driver tables and its work grows with them:

==========================  ==============================================
domain                      driver stand-in
==========================  ==============================================
service fact row            lineitem, town via lineitem -> orders.o_custkey
active / reactive energy    l_extendedprice / o_totalprice * l_tax
maximum power / timestamp   l_quantity / l_shipdate
daily hours                 l_discount * 100
town (level 3)              customer (c_custkey, c_name)
latitude / longitude        nation key / region key of the town's nation
municipality (level 2)      nation (n_nationkey, n_name)
department (level 1)        region (r_regionkey, r_name)
census row (1:1 by town)    customer: c_acctbal as population,
                            |c_acctbal| / 100 as percent in need,
                            4 * c_nationkey as services component
==========================  ==============================================

``region`` and ``nation`` have a size fixed by the TPC-H definition (5 and
25 rows at every scale factor), so they carry a broadcast hint; every other
join is left to the planner (auto-broadcast by statistics, AQE at runtime).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonestats.plans.star import SHORT_LABELS, ViewLabels, star_view

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

# Tables whose row count does not grow with the scale factor (TPC-H spec).
FIXED_SIZE_TABLES = {"region": 5, "nation": 25}

# Declared schemas of the driver tables: reading with them skips Spark's
# footer-reading schema inference job on every scan.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class DriverTables:
    """Lazy parquet readers for ``{sf_dir}/{name}.parquet`` with declared
    schemas (no inference pass)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            reader = self.spark.read
            if name in DRIVER_SCHEMAS:
                reader = reader.schema(DRIVER_SCHEMAS[name])
            self._cache[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def fixed(self, name: str) -> DataFrame:
        """A table of spec-fixed size, hinted for broadcast."""
        assert name in FIXED_SIZE_TABLES, name
        return F.broadcast(self[name])


def services(t: DriverTables) -> DataFrame:
    li, o = t["lineitem"], t["orders"]
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
    return j.select(
        F.col("l_orderkey").alias("id_servicio_order"),
        F.col("l_linenumber").alias("id_servicio_line"),
        F.col("o_custkey").alias("id_centro_poblado"),
        F.col("l_extendedprice").alias("energia_activa"),
        (F.col("o_totalprice") * F.col("l_tax")).alias("energia_reactiva"),
        F.col("l_quantity").alias("potencia_maxima"),
        F.col("l_shipdate").alias("fecha_demanda_maxima"),
        (F.col("l_discount") * F.lit(100.0)).alias("promedio_diario_horas"),
    )


def towns(t: DriverTables) -> DataFrame:
    c, n = t["customer"], t.fixed("nation")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "inner")
    return j.select(
        F.col("c_custkey").alias("id_centro_poblado"),
        F.col("c_name").alias("centro_poblado"),
        F.col("c_nationkey").alias("id_municipio"),
        F.col("n_regionkey").cast("double").alias("longitud"),
        F.col("n_nationkey").cast("double").alias("latitud"),
        F.col("c_mktsegment").alias("clase"),
    )


def municipalities(t: DriverTables) -> DataFrame:
    return t.fixed("nation").select(
        F.col("n_nationkey").alias("id_municipio"),
        F.col("n_name").alias("municipio"),
        F.col("n_regionkey").alias("id_departamento"),
    )


def departments(t: DriverTables) -> DataFrame:
    return t.fixed("region").select(
        F.col("r_regionkey").alias("id_departamento"),
        F.col("r_name").alias("departamento"),
    )


def census(t: DriverTables) -> DataFrame:
    c = t["customer"]
    return c.select(
        F.col("c_custkey").alias("id_centro_poblado"),
        F.col("c_acctbal").alias("personas_hogares_particulares"),
        (F.abs(F.col("c_acctbal")) / F.lit(100.0)).alias("personas_nbi"),
        (F.col("c_nationkey") * F.lit(4.0)).alias("servicios"),
    )


def driver_view(spark: SparkSession, sf_dir: str, labels: ViewLabels = SHORT_LABELS) -> DataFrame:
    t = DriverTables(spark, sf_dir)
    return star_view(services(t), towns(t), municipalities(t), departments(t), census(t), labels)


# The same view in DuckDB SQL over the raw driver tables (used by the oracles).
VIEW_SQL = """
    SELECT r.r_regionkey AS dept_id, r.r_name AS dept_name,
           n.n_nationkey AS muni_id, n.n_name AS muni_name,
           c.c_custkey AS town_id, c.c_name AS town_name,
           CAST(cn.n_nationkey AS DOUBLE) AS lat, CAST(cn.n_regionkey AS DOUBLE) AS lon,
           l.l_extendedprice AS active_energy,
           o.o_totalprice * l.l_tax AS reactive_energy,
           l.l_extendedprice / NULLIF(SQRT(POWER(l.l_extendedprice, 2)
               + POWER(o.o_totalprice * l.l_tax, 2)), 0) AS power_factor,
           l.l_quantity AS max_power, l.l_shipdate AS peak_ts,
           l.l_discount * 100.0 AS daily_hours,
           k.c_acctbal AS population, ABS(k.c_acctbal) / 100.0 AS need_pct,
           CAST(k.c_nationkey AS DOUBLE) * 4.0 AS services_pct
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN (customer c JOIN nation cn ON c.c_nationkey = cn.n_nationkey)
           ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
    LEFT JOIN customer k ON c.c_custkey = k.c_custkey
"""
