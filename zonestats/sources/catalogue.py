"""Catalogue tables of the domain: definitions, load, key audit and the view.

Spark's catalogue takes no key constraints, so the keys of a table are stored
as table properties, and ``audit_table`` checks the rows by them. The service
fact, the towns and the census are bucketed by the town key: joins and
groupings on it need no exchange of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from zonestats import schemas
from zonestats.functions.columns import strict_int
from zonestats.operators.quality import audit_keys
from zonestats.plans.star import REFERENCE_LABELS, ViewLabels

BUCKETS = 16
TOWN_KEY = "id_centro_poblado"
PRIMARY, FOREIGN = "zonestats.primary_key", "zonestats.foreign_keys"
BUCKETED = ("centros_poblados", "servicios_centros_poblados", "cnpv_nbi")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def primary_key(name: str) -> str:
    """The key column of a domain table: its first one."""
    return schemas.ALL[name].fieldNames()[0]


def foreign_keys(name: str) -> dict[str, str]:
    """Column -> table that has it as primary key."""
    owner = {primary_key(t): t for t in schemas.ALL}
    return {c: owner[c] for c in schemas.ALL[name].fieldNames()[1:] if c in owner}


def create_tables(spark: SparkSession, database: str, location: str | None = None, buckets: int = BUCKETS) -> list[str]:
    """Create the database and the nine domain tables if they are not there.
    ``location``: a folder all executors share; else the warehouse."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}{where}")
    for name, schema in schemas.ALL.items():
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
        dealt = f" CLUSTERED BY ({TOWN_KEY}) SORTED BY ({TOWN_KEY}) INTO {buckets} BUCKETS" if name in BUCKETED else ""
        keys = ",".join(f"{c}:{t}" for c, t in foreign_keys(name).items())
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(database)}.{_quoted(name)} ({columns}) USING parquet{dealt} "
                  f"TBLPROPERTIES ('{PRIMARY}' = '{primary_key(name)}', '{FOREIGN}' = '{keys}')")
    return list(schemas.ALL)


def load_table(df: DataFrame, database: str, name: str, overwrite: bool = True) -> None:
    """Write the rows into a table of ``create_tables``: the columns of its
    definition by name, cast as they are declared (a value that does not fit,
    or a fraction for an integer, raises); further columns are left out, those
    the frame lacks are missing. A bucketed table's rows meet in their bucket's
    task, one file a bucket."""
    schema: StructType = schemas.ALL[name]
    have = {f.name: strict_int(f.name) if isinstance(f.dataType, IntegerType) else F.col(f.name).cast(f.dataType)
            for f in schema if f.name in df.columns}
    out = df.select(*[have.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
    if name in BUCKETED:
        spec = df.sparkSession.sql(f"DESCRIBE EXTENDED {_quoted(database)}.{_quoted(name)}").filter("col_name = 'Num Buckets'").first()
        out = out.repartition(int(spec["data_type"]), TOWN_KEY)
    out.write.insertInto(f"{_quoted(database)}.{_quoted(name)}", overwrite=overwrite)


def declared_keys(spark: SparkSession, database: str, name: str) -> tuple[list[str], dict[str, str]]:
    """(primary key, foreign key column -> table) as the catalogue has them."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {_quoted(database)}.{_quoted(name)}").collect()
    props = {r["key"]: r["value"] for r in rows}
    return [props[PRIMARY]], dict(k.split(":") for k in props[FOREIGN].split(",") if k)


def audit_table(spark: SparkSession, database: str, name: str) -> DataFrame:
    """Violations of a table's declared keys (``audit_keys``)."""
    pk, fks = declared_keys(spark, database, name)
    table = {t: spark.table(f"{_quoted(database)}.{_quoted(t)}") for t in {name, *fks.values()}}
    return audit_keys(table[name], pk, {c: (table[t], declared_keys(spark, database, t)[0][0]) for c, t in fks.items()})


def create_view(spark: SparkSession, database: str, view: str = "service_view", labels: ViewLabels = REFERENCE_LABELS) -> str:
    """Store the 17-column view over the tables in the catalogue, so that every
    session reads it by name; returns that name. The places are joined first,
    so the bucketed fact is never exchanged; predicates on place columns reach
    the scans."""
    q = {f: _quoted(getattr(labels, f)) for f in labels.__dataclass_fields__}
    t = {n: f"{_quoted(database)}.{_quoted(n)}" for n in schemas.ALL}
    name = f"{_quoted(database)}.{_quoted(view)}"
    spark.sql(f"""
        CREATE OR REPLACE VIEW {name} AS
        SELECT d.id_departamento AS {q['dept_id']}, d.departamento AS {q['dept_name']},
               m.id_municipio AS {q['muni_id']}, m.municipio AS {q['muni_name']},
               c.id_centro_poblado AS {q['town_id']}, c.centro_poblado AS {q['town_name']},
               c.latitud AS {q['lat']}, c.longitud AS {q['lon']},
               s.energia_activa AS {q['active']}, s.energia_reactiva AS {q['reactive']},
               s.energia_activa / nullif(sqrt(power(s.energia_activa, 2) + power(s.energia_reactiva, 2)), 0) AS {q['pf']},
               s.potencia_maxima AS {q['power']}, s.fecha_demanda_maxima AS {q['ts']}, s.promedio_diario_horas AS {q['hours']},
               n.personas_hogares_particulares AS {q['population']}, n.personas_nbi AS {q['need']}, n.servicios AS {q['services']}
        FROM {t['servicios_centros_poblados']} s
        LEFT JOIN ({t['centros_poblados']} c
                   LEFT JOIN {t['municipios']} m ON c.id_municipio = m.id_municipio
                   LEFT JOIN {t['departamentos']} d ON m.id_departamento = d.id_departamento
                   LEFT JOIN {t['cnpv_nbi']} n ON c.id_centro_poblado = n.id_centro_poblado)
               ON s.id_centro_poblado = c.id_centro_poblado""")
    return name
