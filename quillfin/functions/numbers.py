"""Rounding that engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column | str, digits: int) -> Column:
    """x to so many digits, halves away from zero, decided on the double x * 10**digits.

    Spark's own round decides on the shortest decimal of x instead, which
    differs from other engines at halves such as 2.675.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.round(x * scale, 0) / scale
