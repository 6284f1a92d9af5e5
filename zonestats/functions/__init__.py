from zonestats.functions.columns import (
    RAW_TIMESTAMP_FORMAT,
    classify_expr,
    complement_pct,
    day_name,
    nan_to_null,
    parse_ts,
    power_factor,
    recode_expr,
    round_half_even,
    strict_int,
)

__all__ = [
    "RAW_TIMESTAMP_FORMAT",
    "classify_expr",
    "complement_pct",
    "day_name",
    "nan_to_null",
    "parse_ts",
    "power_factor",
    "recode_expr",
    "round_half_even",
    "strict_int",
]
