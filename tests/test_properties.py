"""Properties on the driver tables: shares, serial keys, encode/decode,
semi/anti split, power factor range."""

from pyspark.sql import functions as F

from zonestats.operators.clean import semi_filter
from zonestats.operators.dims import add_serial, dim_build, dim_encode
from zonestats.operators.quality import missing_keys
from zonestats.operators.rank import share_of_total
from zonestats.plans.standins import DriverTables, driver_view
from zonestats.plans.star import SHORT_LABELS as L

from conftest import SF_SMALL


def test_shares_sum_to_100(spark):
    v = driver_view(spark, SF_SMALL)
    s = share_of_total(v, [L.dept_name], L.active, scale=2).agg(F.sum("share_pct")).first()[0]
    assert abs(s - 100.0) < 1e-9


def test_power_factor_range(spark):
    v = driver_view(spark, SF_SMALL)
    r = v.agg(F.min(L.pf), F.max(L.pf)).first()
    assert -1.0 <= r[0] <= r[1] <= 1.0


def test_serial_ids_are_1_to_n_in_order(spark):
    part = DriverTables(spark, SF_SMALL)["part"]
    vals = part.select("p_name").distinct()
    ids = add_serial(vals, "id", ["p_name"], num_partitions=5).toPandas().sort_values("id")
    assert list(ids["id"]) == list(range(1, len(ids) + 1))
    assert list(ids["p_name"]) == sorted(ids["p_name"])


def test_encode_then_decode_is_identity(spark):
    part = DriverTables(spark, SF_SMALL)["part"].select("p_partkey", "p_brand")
    dim = dim_build(part, ["p_brand"], "id_brand")
    enc = dim_encode(part, [(dim, ["p_brand"], "id_brand")])
    dec = enc.join(dim, "id_brand").select("p_partkey", "p_brand")
    assert dec.exceptAll(part).count() == 0 and part.exceptAll(dec).count() == 0


def test_semi_and_anti_partition_the_input(spark):
    t = DriverTables(spark, SF_SMALL)
    docs, labels = t["documents"].select("doc_id"), t["labels"]
    semi = semi_filter(docs, labels, "doc_id")
    anti = missing_keys(docs, labels, "doc_id")
    assert semi.count() + anti.count() == docs.count()
    assert semi.intersect(anti).count() == 0


def test_declared_driver_schemas_match_files(spark):
    from zonestats.plans.standins import DRIVER_SCHEMAS
    for name, ddl in DRIVER_SCHEMAS.items():
        inferred = spark.read.parquet(f"{SF_SMALL}/{name}.parquet").schema
        declared = DriverTables(spark, SF_SMALL)[name].schema
        assert [(f.name, f.dataType) for f in inferred] == [(f.name, f.dataType) for f in declared], name


def test_exact_sums_do_not_depend_on_partitioning(spark):
    from zonestats.operators.rank import rank_by
    from zonestats.plans.star import SHORT_LABELS as L
    v = driver_view(spark, SF_SMALL).select(L.dept_name, L.active, L.reactive)
    results = []
    for n in (1, 3, 11):
        parted = v.repartition(n)
        r = rank_by(parted, [L.dept_name], L.reactive, "avg", scale=4)
        results.append(sorted(r.collect()))
    assert results[0] == results[1] == results[2]
