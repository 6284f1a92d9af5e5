"""Source/sink reports: CSV written and read back with an explicit schema, the
census built from its exported sheet, the view stored over catalogue tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zonestats.operators.dims import census_build
from zonestats.plans import standins
from zonestats.plans.registry import register, rounded
from zonestats.plans.standins import VIEW_SQL, DriverTables
from zonestats.plans.star import SHORT_LABELS as L
from zonestats.session import scratch_dir
from zonestats.sources.catalogue import create_tables, create_view, load_table
from zonestats.sources.files import read_csv, write_csv
from zonestats.sources.sheets import read_sheet

LINEITEM_CSV_SCHEMA = ("l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                       "l_extendedprice DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ")


@register("csv_roundtrip",
          "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate "
          "FROM lineitem")
def _csv_roundtrip(spark, d):
    """Write the fact columns as CSV (header, one file per task) into the
    shared scratch folder, then scan them back with the declared schema."""
    li = DriverTables(spark, d)["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    path = scratch_dir(spark, f"csv_roundtrip-{uuid.uuid4().hex}")
    write_csv(li, path)
    return read_csv(spark, path, LINEITEM_CSV_SCHEMA)


LEAD, NOTES = 8, 2  # rows above the header and below the data of the census sheet
CENSUS_SHEET = ("c0 STRING, c1 STRING, c2 STRING, c3 STRING, c4 STRING, c5 STRING, c6 STRING, personas_nbi DOUBLE, "
                "servicios DOUBLE, c9 STRING")


def export_census_sheet(spark, d, path):
    """The customers as a census sheet: title rows, a header of mostly unnamed
    columns, one row a town in key order, notes. Title and note rows look like
    data rows, so that only their position tells them apart."""
    t = DriverTables(spark, d)
    c, n = t["customer"], t.fixed("nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").alias("pos"), F.to_csv(F.struct(
            F.col("n_regionkey").cast("string"), F.lit("Region, with a comma"), F.col("c_nationkey").cast("string"), "n_name", "c_mktsegment",
            F.col("c_custkey").cast("string"), "c_name", F.abs(F.col("c_acctbal")) / F.lit(100.0), F.col("c_nationkey") * F.lit(4.0),
            F.floor(F.abs(F.col("c_acctbal"))).cast("string")), {"ignoreLeadingWhiteSpace": "false"}).alias("value"))
    title, header = "9,Total,99,Total,Total,0,Total,1.5,2.5,7", ",,,,,,,NBI,Servicios,"
    lead = [(i - LEAD - 1, title) for i in range(LEAD)] + [(-1, header)]
    notes = [((1 << 62) + i, title) for i in range(NOTES)]
    around = spark.createDataFrame(lead + notes, "pos long, value string")
    rows.unionByName(around).repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.text(path)


@register("census_build",
          "SELECT CAST(c_custkey AS INTEGER) AS id_centro_poblado, abs(c_acctbal) / 100.0 AS personas_nbi, CAST(c_nationkey AS DOUBLE) * 4.0 AS servicios, "
          "CAST(floor(abs(c_acctbal)) AS INTEGER) AS personas_hogares_particulares FROM customer")
def _census_build(spark, d):
    path = scratch_dir(spark, f"census-sheet-{uuid.uuid4().hex}")
    export_census_sheet(spark, d, path)
    sheet = read_sheet(spark, path, CENSUS_SHEET, lead=LEAD + 1, tail=NOTES)
    return census_build(sheet, {"c5": "id_centro_poblado", "c9": "personas_hogares_particulares"},
                        ["id_centro_poblado", "personas_hogares_particulares"], ["c0", "c1", "c2", "c3", "c4", "c6"])


def load_driver_tables(spark, d, database, location):
    """The domain tables of the driver's in a catalogue database."""
    t = DriverTables(spark, d)
    create_tables(spark, database, location)
    census = standins.census(t).withColumn("personas_hogares_particulares", F.floor("personas_hogares_particulares"))
    for name, rows in (("departamentos", standins.departments(t)), ("municipios", standins.municipalities(t)),
                       ("centros_poblados", standins.towns(t)), ("cnpv_nbi", census), ("servicios_centros_poblados", standins.services(t))):
        load_table(rows, database, name)


@register("catalogue_view",
          f"WITH v AS ({VIEW_SQL}) SELECT dept_id, dept_name, muni_id, muni_name, CAST(town_id AS INTEGER) AS town_id, town_name, lat, lon, "
          "round(active_energy, 4) AS active_energy, round(reactive_energy, 4) AS reactive_energy, round(power_factor, 9) AS power_factor, "
          "max_power, peak_ts, round(daily_hours, 6) AS daily_hours, CAST(floor(population) AS INTEGER) AS population, "
          "round(need_pct, 6) AS need_pct, services_pct FROM v WHERE dept_id = 2")
def _catalogue_view(spark, d):
    """The stored view, read by name, for one department."""
    database = f"zonestats_{uuid.uuid4().hex}"
    load_driver_tables(spark, d, database, scratch_dir(spark, database))
    view = create_view(spark, database, labels=L)
    return rounded(spark.table(view).where(F.col(L.dept_id) == 2), 6, {L.active: 4, L.reactive: 4, L.pf: 9})
