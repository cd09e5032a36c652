"""Interest and health expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 31_536_000.0


def linear(rate: Column, seconds: Column) -> Column:
    return 1 + rate * seconds / YEAR


def compounded(rate: Column, seconds: Column) -> Column:
    """Three terms of (1 + rate / year) ** seconds; 1 if no time has passed."""
    per, t = rate / YEAR, seconds
    second = t * (t - 1) * per * per / 2
    third = t * (t - 1) * (t - 2) * per * per * per / 6
    return F.when(t <= 0, 1.0).otherwise(1 + t * per + second + F.when(t > 2, third).otherwise(0.0))


def hf_band(hf: Column) -> Column:
    """Right-closed bands of the health factor; null is no_debt."""
    c = F.when(hf.isNull(), "no_debt").when(hf <= 1, "<=1")
    for lo, hi in (("1", 1.1), ("1.1", 1.25), ("1.25", 1.5), ("1.5", 2.0)):
        c = c.when(hf <= hi, f"{lo}-{hi:g}")
    return c.otherwise(">2")
