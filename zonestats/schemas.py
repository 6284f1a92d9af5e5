"""Explicit schemas of the domain tables (the source database's DDL)."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _s(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


I, S, D, T = IntegerType(), StringType(), DoubleType(), TimestampNTZType()

DEPARTMENTS = _s(("id_departamento", I, False), ("departamento", S, True))
DISTRICTS = _s(("id_distrito", I, False), ("distrito", S, True))
METRO_AREAS = _s(("id_area_metropolitana", I, False), ("area_metropolitana", S, True))
MUNICIPALITY_TYPES = _s(("id_tipo_municipio", I, False), ("tipo_municipio", S, True))
CLASSES = _s(("id_clase", I, False), ("clase", S, True))
MUNICIPALITIES = _s(
    ("id_municipio", I, False), ("municipio", S, True), ("id_departamento", I, True),
    ("id_distrito", I, True), ("id_tipo_municipio", I, True), ("id_area_metropolitana", I, True))
TOWNS = _s(
    ("id_centro_poblado", I, False), ("centro_poblado", S, True), ("id_municipio", I, True),
    ("longitud", D, True), ("latitud", D, True), ("id_clase", I, True))
SERVICES = _s(
    ("id_servicio", I, False), ("id_centro_poblado", I, True), ("energia_activa", D, True),
    ("energia_reactiva", D, True), ("potencia_maxima", D, True),
    ("fecha_demanda_maxima", T, True), ("promedio_diario_horas", D, True))
CENSUS = _s(
    ("id_cnpv_nbi", I, False), ("id_centro_poblado", I, True), ("personas_nbi", D, True),
    ("personas_miseria", D, True), ("vivienda", D, True), ("servicios", D, True),
    ("hacinamiento", D, True), ("inasistencia", D, True), ("dependencia_economica", D, True),
    ("personas_hogares_particulares", I, True))

ALL = {
    "departamentos": DEPARTMENTS, "distritos": DISTRICTS, "areas_metropolitanas": METRO_AREAS,
    "tipos_municipio": MUNICIPALITY_TYPES, "clases": CLASSES, "municipios": MUNICIPALITIES,
    "centros_poblados": TOWNS, "servicios_centros_poblados": SERVICES, "cnpv_nbi": CENSUS,
}

# The class and municipality-type rows inserted by the load
# script, in insertion order (ids 1, 2, 3).
CLASS_ROWS = ["CABECERA MUNICIPAL", "CENTRO POBLADO", "RURAL DISPERSO"]
MUNICIPALITY_TYPE_ROWS = ["MUNICIPIO", "ISLA", "AREA NO MUNICIPALIZADA"]
