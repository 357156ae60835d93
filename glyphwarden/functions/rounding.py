"""Rounding of doubles as SQL engines do it: by the scaled value.

Spark's round() goes by the shortest decimal text of a double and Python's by its exact value.  At a half
of the last place all three may differ, so a result that is compared or joined elsewhere has one rule: the double is
multiplied by a power of ten, rounded to a whole number, and divided by it.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """c to `digits` decimals, halves of the scaled value away from zero."""
    scale = F.lit(10.0**digits)
    return F.round(c * scale) / scale


def rounded_sql(c: str, digits: int) -> str:
    """The same as SQL."""
    return f"(round(({c}) * {10.0**digits}D) / {10.0**digits}D)"


def half_up(x: float, digits: int) -> float:
    """The same of a Python float."""
    scale = 10.0**digits
    y = x * scale
    whole = math.trunc(y)
    return (whole + int(math.copysign(abs(y - whole) >= 0.5, y))) / scale


def half_even(x: float, digits: int) -> float:
    """A Python float, halves of the scaled value to the even neighbour."""
    scale = 10.0**digits
    return round(x * scale) / scale


def exact_half_up(x: float, digits: int) -> float:
    """A Python float by its first 18 decimals, halves away from zero: for means that stand exactly between two steps."""
    return float(Decimal(f"{x:.18f}").quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
