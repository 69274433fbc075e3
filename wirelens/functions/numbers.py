"""Rounding and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelens.fixed_values import BYTE_UNITS, NUMBER_UNITS


def round_half_up(x: Column, digits: int) -> Column:
    """Half-up on the decimal value, so engines agree (a raw double rounds by its binary value)."""
    return F.round(x.cast("decimal(30,8)"), digits).cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def _one_decimal(n: Column, unit: int) -> Column:
    """``n / unit`` half-up to one decimal, exact for non-negative numbers of up to 30 digits before the
    point; a quotient of that size would be cut to few decimals first and then rounded again."""
    tenfold, size = n.cast("decimal(36,6)") * F.lit(10).cast("decimal(2,0)"), F.lit(unit).cast("decimal(13,0)")
    rest = tenfold % size
    tenths = (tenfold - rest) / size + F.when(rest * 2 >= size, 1).otherwise(0)
    return (tenths / F.lit(10).cast("decimal(2,0)")).cast("decimal(34,1)").cast("string")


def human_bytes(n: Column | str) -> Column:
    """1536 -> '1.5 KB'. Unit edges are compared as integers; beyond GB stays in GB."""
    n = F.col(n) if isinstance(n, str) else n
    exact = n.cast("decimal(30,0)")
    out = F.concat(n.cast("long").cast("string"), F.lit(f" {BYTE_UNITS[0]}"))
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        text = F.regexp_replace(_one_decimal(exact, 1024 ** power), r"\.0$", "")
        out = F.when(n >= 1024 ** power, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNull() | (n == 0), F.lit("0 B")).otherwise(out)


def human_number(n: Column | str) -> Column:
    """1500 -> '1.5K'; below a thousand the number itself."""
    n = F.col(n) if isinstance(n, str) else n
    out = n.cast("string")
    for scale, suffix in reversed(NUMBER_UNITS):
        out = F.when(n >= scale, F.concat(_one_decimal(n, scale), F.lit(suffix))).otherwise(out)
    return out
