"""Clamps and log-space arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of frequencies and proportions, and of the quasi-Newton factor.
LOW, HIGH = 1e-5, 1 - 1e-5
QN_LOW, QN_HIGH = 1.0, 96.0


def clamp(x: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def logsumexp(values: str) -> Column:
    """log of the sum of exponentials of an array column, shifted by its maximum."""
    return F.expr(f"array_max({values}) + ln(aggregate({values}, 0D, (a, x) -> a + exp(x - array_max({values}))))")


def round6(x: Column) -> Column:
    """Six decimals, halves away from 0, as the SQL rounds: by the nearest millionth, without a decimal for every row.
    Adds 0 so that no negative zero is left."""
    x = x.cast("double")
    near = F.floor(F.abs(x) * 1e6 + 0.5) / 1e6
    return F.when(F.abs(x) < 1e9, F.when(x < 0, -near).otherwise(near)).otherwise(F.round(x, 6)) + F.lit(0.0)
