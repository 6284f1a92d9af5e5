"""The fact build as an incremental stream: each raw file processed once."""

import datetime as dt
import os
import tempfile

from zonestats.streaming import ingest_facts

RAW_SCHEMA = ("ID_LOCALIDAD INT, ENERGIA_ACTIVA DOUBLE, FECHA STRING, MUNICIPIO STRING")


def _write(path, rows):
    with open(path, "w") as f:
        f.write("ID_LOCALIDAD,ENERGIA_ACTIVA,FECHA,MUNICIPIO\n")
        for r in rows:
            f.write(",".join(str(x) for x in r) + "\n")


def test_ingest_is_incremental(spark):
    base = tempfile.mkdtemp(prefix="zs-stream-")
    raw, out, ckpt = (os.path.join(base, x) for x in ("raw", "out", "ckpt"))
    os.makedirs(raw)
    _write(os.path.join(raw, "day1.csv"), [(1, 10.5, "05/21/2025 07:30:00 PM", "A"),
                                           (2, 3.0, "5/21/2025 1:05:00 AM", "B")])
    q = ingest_facts(spark, raw, out, RAW_SCHEMA, "FECHA", drop=["MUNICIPIO"], checkpoint=ckpt)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.columns == ["ID_LOCALIDAD", "ENERGIA_ACTIVA", "FECHA"]
    assert sorted(r["FECHA"] for r in got.collect()) == [dt.datetime(2025, 5, 21, 1, 5),
                                                         dt.datetime(2025, 5, 21, 19, 30)]
    _write(os.path.join(raw, "day2.csv"), [(1, 11.0, "05/22/2025 08:00:00 PM", "A")])
    q = ingest_facts(spark, raw, out, RAW_SCHEMA, "FECHA", drop=["MUNICIPIO"], checkpoint=ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
