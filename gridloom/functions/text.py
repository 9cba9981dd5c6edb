"""Number and missing-value text: prefix parses and the fixed formats of the sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .projection import _c

#: Fixed values that stand for a missing field in delimited input.
MISSING = ("", "NA")


def prefix_int(v: str) -> Column:
    """The whole number a text begins with; null if none or out of range of an int."""
    return F.expr(rf"try_cast(regexp_extract({_name(v)}, r'^\s*([+-]?[0-9]+)', 1) as int)")


def _name(v: str) -> str:
    return ".".join(f"`{p}`" for p in v.split("."))


def count_value(v: str) -> Column:
    """Count fields: prefix parse, 0 where no number leads."""
    return F.coalesce(prefix_int(v), F.lit(0))


def prefix_double(v: str) -> Column:
    """The number a text begins with, null if none: 12abc is 12."""
    return F.expr(rf"try_cast(nullif(regexp_extract({_name(v)}, r'^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') as double)")


def fixed(v: Column | str, digits: int = 3) -> Column:
    """printf's %.nf: ties of the exact binary value, no group separators."""
    return F.call_function("format_number", _c(v), F.lit("0." + "0" * digits if digits else "0"))


def general(v: Column | str, digits: int) -> Column:
    """printf's %.ng: the shorter of fixed and exponent form without trailing zeros."""
    v = _c(v)
    raw = F.format_string(f"%.{digits - 1}e", v)
    mantissa, power = F.regexp_replace(F.split(raw, "e")[0], r"\.?0+$", ""), F.split(raw, "e")[1].cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    exponent = F.concat(mantissa, F.lit("e"), sign, F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    plain = F.lit(None).cast("string")
    for p in range(-4, digits):
        shown = F.format_string(f"%.{max(0, digits - 1 - p)}f", v)
        shown = F.when(F.instr(shown, ".") > 0, F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
        plain = F.when(power == p, shown).otherwise(plain)
    return F.when(v == 0, F.lit("0")).when((power < -4) | (power >= digits), exponent).otherwise(plain)


def filled(v: Column | str, missing: str = "NA") -> Column:
    """Null and empty fields become the missing value."""
    v = _c(v)
    return F.when(v.isNull() | (v == ""), F.lit(missing)).otherwise(v)
