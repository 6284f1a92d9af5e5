"""Model invariants (k-means, PCA) and sources/sinks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from zonestats.operators.cluster import elbow, kmeans_labels, pca2, standardize
from zonestats.plans.standins import driver_view
from zonestats.plans.star import SHORT_LABELS as L
from zonestats.sources.files import is_number, read_csv, read_preamble_csv, write_csv
from zonestats.sources.jdbc import jdbc_options

from conftest import SF_SMALL

FEATURES = [L.active, L.reactive, L.power, L.hours, L.pf]


@pytest.fixture(scope="module")
def zview(spark):
    v = driver_view(spark, SF_SMALL).select(L.town_id, *FEATURES).dropna()
    return standardize(v, FEATURES).cache()


def test_standardized_columns(zview):
    r = zview.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(FEATURES)]).first()
    for i in range(len(FEATURES)):
        assert abs(r[f"m{i}"]) < 1e-9 and abs(r[f"s{i}"] - 1.0) < 1e-9


def test_elbow_invariants(zview):
    rows = elbow(zview, FEATURES, ks=[2, 3, 5]).orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 5]
    assert all(r["inertia"] >= 0 for r in rows)
    assert rows[-1]["inertia"] < rows[0]["inertia"]


def test_kmeans_labels(zview):
    k = 4
    lab = kmeans_labels(zview, FEATURES, k=k, seed=42)
    got = {r[0] for r in lab.select("cluster").distinct().collect()}
    assert got <= set(range(k)) and len(got) >= 2
    again = kmeans_labels(zview, FEATURES, k=k, seed=42)
    assert lab.select(L.town_id, "cluster").exceptAll(again.select(L.town_id, "cluster")).count() == 0


def test_pca_invariants(zview):
    p = pca2(zview, FEATURES)
    r = p.agg(F.avg("PC1"), F.avg("PC2"), F.var_pop("PC1"), F.var_pop("PC2")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1]) < 1e-9
    assert r[2] >= r[3]


def test_csv_roundtrip_and_bom(spark):
    d = tempfile.mkdtemp(prefix="zs-csv-")
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "id int, name string, x double")
    write_csv(df, os.path.join(d, "out"))
    back = read_csv(spark, os.path.join(d, "out"), "id int, name string, x double")
    assert sorted(back.collect()) == sorted(df.collect())
    p = os.path.join(d, "bom.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("Código,Nombre\n1,X\n")
    assert read_csv(spark, p).columns == ["Código", "Nombre"]


def test_preamble_csv(spark):
    d = tempfile.mkdtemp(prefix="zs-pre-")
    p = os.path.join(d, "sheet.csv")
    lines = [f"title line {i},," for i in range(8)] + ["code,name,total"]
    lines += ["5001,Town A,10", "5002,Town B,20", "Source: census,,", "Note,,"]
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    df = read_preamble_csv(spark, p, "code string, name string, total string", is_number("code"))
    assert [(r["code"], r["total"]) for r in df.collect()] == [("5001", "10"), ("5002", "20")]


def test_jdbc_options():
    o = jdbc_options("jdbc:postgresql://host/db", query="SELECT * FROM v", partition_column="id",
                     lower_bound=1, upper_bound=100, num_partitions=4)
    assert o["dbtable"] == "(SELECT * FROM v) AS src" and "query" not in o
    assert o["numPartitions"] == "4" and o["preferTimestampNTZ"] == "true"
    o2 = jdbc_options("jdbc:postgresql://host/db", table="public.service_view")
    assert o2["dbtable"] == "public.service_view" and "password" not in o2
    with pytest.raises(ValueError):
        jdbc_options("u")


def test_census_build_from_sheet_export(spark):
    """DM4: preamble/footer cut by predicate, unnamed columns renamed,
    strict integer casts, identifying text columns dropped."""
    from zonestats.operators.clean import drop_columns, rename_columns, strict_int_cast
    d = tempfile.mkdtemp(prefix="zs-census-")
    p = os.path.join(d, "census.csv")
    lines = [f"preamble {i},,,," for i in range(8)]
    lines += [",,,,Personas en NBI", "91,AMAZONAS,91001,LETICIA,41.5,12.0,350",
              "91,AMAZONAS,91001005,SANTA SOFIA,80.25,60.0,1200",
              "Fuente: censo,,,,,,", "Nota,,,,,,"]
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    raw = read_preamble_csv(
        spark, p,
        "c0 string, c1 string, c2 string, c3 string, nbi double, servicios double, c6 string",
        is_number("c2"))
    census = rename_columns(raw, {"c2": "id_centro_poblado", "c6": "personas_hogares_particulares"})
    census = strict_int_cast(census, ["id_centro_poblado", "personas_hogares_particulares"], "int")
    census = drop_columns(census, ["c0", "c1", "c3"])
    rows = sorted(census.collect())
    assert census.columns == ["id_centro_poblado", "nbi", "servicios", "personas_hogares_particulares"]
    assert [tuple(r) for r in rows] == [(91001, 41.5, 12.0, 350), (91001005, 80.25, 60.0, 1200)]


def test_parquet_sink_partitioned(spark):
    from zonestats.sources.files import write_parquet
    d = tempfile.mkdtemp(prefix="zs-pq-")
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, "a", 4.0)], "id int, k string, v double")
    write_parquet(df, os.path.join(d, "t"), partition_by=["k"])
    back = spark.read.parquet(os.path.join(d, "t")).where("k = 'a'")
    assert sorted(r["id"] for r in back.collect()) == [1, 3]
