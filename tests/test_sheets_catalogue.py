"""Rows cut by position in sheets of many splits; catalogue tables, their
declared keys and the stored view."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from zonestats import schemas
from zonestats.operators.dims import census_build
from zonestats.plans.reports_io import load_driver_tables
from zonestats.plans.standins import driver_view
from zonestats.plans.star import REFERENCE_LABELS, SHORT_LABELS
from zonestats.session import scratch_dir
from zonestats.sources.catalogue import (audit_table, create_tables, create_view, declared_keys, foreign_keys, load_table,
                                         primary_key)
from zonestats.sources.sheets import cut_positions, read_lines, read_sheet

from conftest import SF_SMALL


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "100b", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def sheet(files):
    folder = tempfile.mkdtemp(prefix="zs-sheet-")
    for i, lines in enumerate(files):
        with open(os.path.join(folder, f"part-{i:05d}.txt"), "w") as f:
            f.write("".join(f"{v}\n" for v in lines))
    return folder


@pytest.mark.parametrize("lead,tail", [(0, 0), (9, 2), (1, 0), (0, 3), (40, 37), (150, 5), (197, 1), (198, 0), (120, 120), (500, 0)])
def test_rows_are_cut_by_position(spark, small_splits, lead, tail):
    lines = [f"{i},same text,{'x' * (i % 7)}" for i in range(198)]
    path = sheet([lines[:70], [], lines[70:71], lines[71:]])
    rows = read_lines(spark, path)
    assert rows.select("file", "block").distinct().count() > 20
    want = lines[lead:len(lines) - tail] if lead + tail < len(lines) else []
    assert sorted(r["value"] for r in cut_positions(rows, lead, tail).collect()) == sorted(want)


def test_census_from_a_sheet_of_many_splits(spark, small_splits):
    data = [f'91,"AMAZONAS, X",{91001000 + i},TOWN {i},{i}.5,{"" if i == 3 else 10 * i}' for i in range(60)]
    path = sheet([["91,title,91001000,TOWN,0.5,1"] * 8 + [",,,,NBI,"] + data + ["91,note,5,T,1.0,1"] * 2])
    raw = read_sheet(spark, path, "c0 string, c1 string, c2 string, c3 string, nbi double, c5 string", lead=9, tail=2)
    got = census_build(raw, {"c2": "town", "c5": "people"}, ["town", "people"], ["c0", "c1", "c3"])
    assert got.columns == ["town", "nbi", "people"]
    assert sorted(tuple(r) for r in got.collect()) == [(91001000 + i, i + 0.5, None if i == 3 else 10 * i) for i in range(60)]


def test_a_sheet_row_that_does_not_fit_raises(spark):
    path = sheet([["title", "1,x", "2,3"]])
    with pytest.raises(Exception):
        read_sheet(spark, path, "a int, b int", lead=1).collect()
    with pytest.raises(ValueError, match="not found"):
        census_build(read_sheet(spark, path, "a string, b string", lead=1), {"c": "d"}, [])


@pytest.fixture(scope="module")
def database(spark):
    name = f"zs_{uuid.uuid4().hex}"
    load_driver_tables(spark, SF_SMALL, name, scratch_dir(spark, name))
    return name


def test_keys_are_declared(spark, database):
    assert {t: primary_key(t) for t in schemas.ALL}["municipios"] == "id_municipio"
    assert foreign_keys("centros_poblados") == {"id_municipio": "municipios", "id_clase": "clases"}
    assert declared_keys(spark, database, "servicios_centros_poblados") == (["id_servicio"], {"id_centro_poblado": "centros_poblados"})
    assert spark.sql(f"SHOW TABLES IN {database}").count() >= 9


def test_audit_by_declared_keys(spark):
    name = f"zs_{uuid.uuid4().hex}"
    create_tables(spark, name, scratch_dir(spark, name))
    create_tables(spark, name)  # again: nothing changes
    load_table(spark.createDataFrame([(1, "A", "extra"), (1, "B", "extra"), (None, "C", "extra")],
                                     "id_departamento long, departamento string, more string"), name, "departamentos")
    load_table(spark.createDataFrame([(10, 1), (11, 7), (12, None)], "id_municipio int, id_departamento int"), name, "municipios")
    assert sorted(tuple(r) for r in audit_table(spark, name, "departamentos").collect()) == [("duplicate_pk", "1", 2), ("missing_pk", None, 1)]
    assert [tuple(r) for r in audit_table(spark, name, "municipios").collect()] == [("fk:id_departamento", "7", 1)]
    with pytest.raises(Exception, match="whole number"):
        load_table(spark.createDataFrame([(1.5,)], "id_municipio double"), name, "municipios")


def test_stored_view_in_another_session(spark, database):
    name = create_view(spark, database, "short", SHORT_LABELS)
    got = spark.newSession().table(name)
    want = driver_view(spark, SF_SMALL)
    assert got.columns == want.columns
    change = [F.floor(c).cast("int").alias(c) if c == "population" else F.col(c).cast(got.schema[c].dataType).alias(c) for c in want.columns]
    other = spark.table(name)
    assert other.exceptAll(want.select(*change)).count() == 0 and other.count() == want.count()
    full = create_view(spark, database)
    assert spark.table(full).columns == REFERENCE_LABELS.ordered()


def test_bucketed_fact_is_not_exchanged(spark, database):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        name = create_view(spark, database, "planned", SHORT_LABELS)
        view = spark.table(name)
        per_town = view.groupBy("town_id").agg(F.sum("active_energy"))
        text = per_town._jdf.queryExecution().executedPlan().toString()
        fact = text[text.index("SortMergeJoin"):]
        scan = next(i for i, line in enumerate(text.splitlines()) if "servicios_centros_poblados" in line)
        above = text.splitlines()[:scan]
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        own, path = depth(text.splitlines()[scan]), []
        for line in reversed(above):  # the operators above the fact's scan
            if depth(line) < own:
                own = depth(line)
                path.append(line)
        assert "Bucketed: true" in text.splitlines()[scan] and fact
        joined = next(i for i, line in enumerate(path) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in path[:joined])
        one = spark.table(name).where("dept_id = 2")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(id_departamento,2)" in one
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
