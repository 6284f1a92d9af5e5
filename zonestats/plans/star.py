"""The analytic star view: service facts joined to place hierarchy and census.

Domain tables (column names as declared in the source database):

* services  (id_servicio, id_centro_poblado, energia_activa, energia_reactiva,
             potencia_maxima, fecha_demanda_maxima, promedio_diario_horas)
* towns     (id_centro_poblado, centro_poblado, id_municipio, longitud, latitud, id_clase)
* municipalities (id_municipio, municipio, id_departamento, ...)
* departments (id_departamento, departamento)
* census    (id_cnpv_nbi, id_centro_poblado, personas_nbi, servicios,
             personas_hogares_particulares, ...)

Semantics are those of the source view: four LEFT joins
(fact -> town -> municipality -> department, town -> census), power factor
with a zero guard. A town with two census rows doubles its service rows,
exactly like the SQL view.

Plan shape. The three dimension joins and the census join all hang off the
town, so they are done first on the (small) place side; the fact is then
joined once, on the town key. Left joins re-associate this way because every
later predicate only references the town side and rejects NULLs. The fact is
therefore shuffled at most once (or not at all when AQE/auto-broadcast finds
the place side small), instead of once per dimension.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestats.functions.columns import power_factor

@dataclass(frozen=True)
class ViewLabels:
    dept_id: str
    dept_name: str
    muni_id: str
    muni_name: str
    town_id: str
    town_name: str
    lat: str
    lon: str
    active: str
    reactive: str
    pf: str
    power: str
    ts: str
    hours: str
    population: str
    need: str
    services: str

    @property
    def level_keys(self) -> dict[int, list[str]]:
        """Name keys per hierarchy level (1 department, 2 + municipality, 3 + town)."""
        return {
            1: [self.dept_name],
            2: [self.dept_name, self.muni_name],
            3: [self.dept_name, self.muni_name, self.town_name],
        }

    @property
    def measures(self) -> list[str]:
        return [self.active, self.reactive, self.pf, self.power, self.hours]

    def ordered(self) -> list[str]:
        return [self.dept_id, self.dept_name, self.muni_id, self.muni_name, self.town_id,
                self.town_name, self.lat, self.lon, self.active, self.reactive, self.pf,
                self.power, self.ts, self.hours, self.population, self.need, self.services]


# The column headers of the source view, in its order.
REFERENCE_LABELS = ViewLabels(
    dept_id="Código Departamento",
    dept_name="Departamento",
    muni_id="Código Municipio",
    muni_name="Municipio",
    town_id="Código Centro Poblado",
    town_name="Centro Poblado",
    lat="Latitud",
    lon="Longitud",
    active="Energía Activa [kWh]",
    reactive="Energía Reactiva [kVArh]",
    pf="Factor de Potencia",
    power="Potencia Máxima [kW]",
    ts="Fecha Demanda Máxima",
    hours="Promedio Diario [h]",
    population="Total Personas en Hogares Particulares",
    need="Personas en NBI [%]",
    services="Componente Servicios [%]",
)

# Plain identifiers, used for the driver-table queries and SQL oracles.
SHORT_LABELS = ViewLabels(
    dept_id="dept_id",
    dept_name="dept_name",
    muni_id="muni_id",
    muni_name="muni_name",
    town_id="town_id",
    town_name="town_name",
    lat="lat",
    lon="lon",
    active="active_energy",
    reactive="reactive_energy",
    pf="power_factor",
    power="max_power",
    ts="peak_ts",
    hours="daily_hours",
    population="population",
    need="need_pct",
    services="services_pct",
)


def place_dimension(towns: DataFrame, municipalities: DataFrame, departments: DataFrame,
                    census: DataFrame, labels: ViewLabels = SHORT_LABELS,
                    census_unique: bool = False) -> DataFrame:
    """town LEFT JOIN municipality LEFT JOIN department LEFT JOIN census,
    one row per (town, census row).

    ``census_unique``: the caller asserts one census row per town (a
    primary key). The census side is then grouped by town, which makes the
    uniqueness visible to Catalyst, so queries that use no census column
    lose the census join altogether. The default keeps the source view's
    semantics (a duplicated census row doubles the town's rows)."""
    t = towns.select(
        F.col("id_centro_poblado").alias("_tid"),
        F.col("centro_poblado").alias(labels.town_name),
        F.col("id_municipio").alias("_mid"),
        F.col("latitud").alias(labels.lat),
        F.col("longitud").alias(labels.lon),
    )
    m = municipalities.select(
        F.col("id_municipio").alias("_m_mid"),
        F.col("municipio").alias(labels.muni_name),
        F.col("id_departamento").alias("_did"),
    )
    d = departments.select(
        F.col("id_departamento").alias(labels.dept_id),
        F.col("departamento").alias(labels.dept_name),
    )
    n = census.select(
        F.col("id_centro_poblado").alias("_n_tid"),
        F.col("personas_hogares_particulares").alias(labels.population),
        F.col("personas_nbi").alias(labels.need),
        F.col("servicios").alias(labels.services),
    )
    if census_unique:  # one row per town: max() is that row's value
        n = n.groupBy("_n_tid").agg(*[F.max(c).alias(c) for c in n.columns if c != "_n_tid"])
    tm = t.join(m, t["_mid"] == m["_m_mid"], "left")
    tmd = tm.join(d, tm["_did"] == d[labels.dept_id], "left")
    place = tmd.join(n, tmd["_tid"] == n["_n_tid"], "left")
    return place.select(
        F.col(labels.dept_id), F.col(labels.dept_name),
        F.col("_m_mid").alias(labels.muni_id), F.col(labels.muni_name),
        F.col("_tid").alias(labels.town_id), F.col(labels.town_name),
        F.col(labels.lat), F.col(labels.lon),
        F.col(labels.population), F.col(labels.need), F.col(labels.services),
    )


def star_view(services: DataFrame, towns: DataFrame, municipalities: DataFrame,
              departments: DataFrame, census: DataFrame,
              labels: ViewLabels = SHORT_LABELS,
              census_unique: bool = False) -> DataFrame:
    """The 17-column analytic view, lazily. Callers select what they need;
    Catalyst prunes the rest down to the parquet scans.

    The place side is a join tree, whose static size estimate never allows
    a broadcast; AQE could only switch after the fact had been shuffled. So
    whether the place dimension is broadcast or merge-joined is left to the
    planner's statistics and AQE."""
    place = place_dimension(towns, municipalities, departments, census, labels, census_unique)
    e = services.select(
        F.col("id_centro_poblado").alias("_e_tid"),
        F.col("energia_activa").alias(labels.active),
        F.col("energia_reactiva").alias(labels.reactive),
        F.col("potencia_maxima").alias(labels.power),
        F.col("fecha_demanda_maxima").alias(labels.ts),
        F.col("promedio_diario_horas").alias(labels.hours),
    )
    joined = e.join(place, e["_e_tid"] == place[labels.town_id], "left")
    return joined.select(
        labels.dept_id, labels.dept_name, labels.muni_id, labels.muni_name,
        labels.town_id, labels.town_name, labels.lat, labels.lon,
        labels.active, labels.reactive,
        power_factor(labels.active, labels.reactive).alias(labels.pf),
        labels.power, labels.ts, labels.hours,
        labels.population, labels.need, labels.services,
    )
