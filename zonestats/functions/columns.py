"""Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen; there is no
row-at-a-time Python UDF in the package.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def power_factor(active: ColumnOrName, reactive: ColumnOrName) -> Column:
    """a / sqrt(a^2 + r^2); a zero denominator gives NULL instead of an error."""
    a, r = col(active), col(reactive)
    return a / F.nullif(F.sqrt(F.pow(a, 2) + F.pow(r, 2)), F.lit(0.0))


def round_half_even(c: ColumnOrName, decimals: int = 2) -> Column:
    """Round like numpy: rint(x * 10^d) / 10^d (0.125 -> 0.12)."""
    scale = float(10**decimals)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def complement_pct(c: ColumnOrName, whole: float = 100.0) -> Column:
    """``whole - x``, e.g. the share of people *not* in need."""
    return F.lit(whole) - col(c)


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN is a value in Spark aggregates; the analyses treat it as missing."""
    x = col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def strict_int(c: ColumnOrName, to: str = "int") -> Column:
    """Cast to an integer type, raising on text that is not a number and on
    a float with a fractional part (2.0 -> 2, 2.7 -> error, NULL -> NULL)."""
    x = col(c)
    as_double = x.cast("double")
    fractional = F.typeof(x).rlike("^(float|double|decimal)")  # a constant once the type is known
    return F.when(x.isNull(), F.lit(None).cast(to)).when(~fractional, x.cast(to)).when(
        as_double == F.floor(as_double), x.cast(to)
    ).otherwise(
        F.raise_error(F.concat(F.lit("value is not a whole number: "), x.cast("string")))
        .cast(to)
    )


# Fixed value: the timestamp text format of the raw energy file
# (month/day/year, 12-hour clock with AM/PM marker). One- and two-digit
# months, days and hours are both accepted.
RAW_TIMESTAMP_FORMAT = "M/d/yyyy h:mm:ss a"


def parse_ts(c: ColumnOrName, fmt: str = RAW_TIMESTAMP_FORMAT, strict: bool = True) -> Column:
    """Text -> zone-less timestamp. ``strict`` raises on bad text, else NULL."""
    if strict:
        return F.to_timestamp_ntz(col(c), F.lit(fmt))
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("timestamp_ntz")


def day_name(c: ColumnOrName) -> Column:
    """Full English weekday name of a timestamp."""
    return F.date_format(col(c), "EEEE")


def recode_expr(c: ColumnOrName, mapping: Mapping, value_type: str | None = None) -> Column:
    """Dictionary lookup; keys not in the mapping (and NULL) give NULL."""
    if not mapping:
        return F.lit(None).cast(value_type or "string")
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    out = F.when(col(c).isNull(), F.lit(None)).otherwise(F.try_element_at(m, col(c)))
    return out.cast(value_type) if value_type else out


def classify_expr(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Ordered rules, first match wins: [(condition, label), ...]."""
    if not rules:
        return F.lit(default)
    cond, label = rules[0]
    expr = F.when(cond, F.lit(label))
    for cond, label in rules[1:]:
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def float_text(c: ColumnOrName) -> Column:
    """A double as text the way Python prints it (pandas labels): fixed
    notation for 1e-4 <= |x| < 1e16, else ``1.5e-05`` / ``1e+16``. Spark's
    own cast gives the same digits but switches to ``2.1E-4`` style below
    1e-3 and from 1e7 on; those cases are rewritten."""
    s = col(c).cast("string")
    pat = r"^(-?)([0-9.]+)E(-?[0-9]+)$"
    sign = F.regexp_extract(s, pat, 1)
    mant = F.regexp_extract(s, pat, 2)
    exp = F.regexp_extract(s, pat, 3).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mant, r"\.", ""), "0+$", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    n = F.length(digits)
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    int_part = F.rpad(F.substr(digits, F.lit(1), exp + 1), exp + 1, F.lit("0"))
    frac = F.when(n > exp + 1, F.substr(digits, exp + 2, n)).otherwise(F.lit("0"))
    fixed = F.concat(sign, int_part, F.lit("."), frac)
    e_abs = F.abs(exp).cast("string")
    e_txt = F.when(F.length(e_abs) < 2, F.concat(F.lit("0"), e_abs)).otherwise(e_abs)
    sci = F.concat(sign, F.regexp_replace(mant, r"\.0$", ""), F.lit("e"),
                   F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), e_txt)
    conv = F.when((exp >= -4) & (exp < 0), small).when((exp >= 0) & (exp < 16), fixed).otherwise(sci)
    return F.when(s.rlike(pat), conv).otherwise(s)
