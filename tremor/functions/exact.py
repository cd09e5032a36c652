"""Sums of 256-bit whole numbers that are kept as text: vectors of limbs, added one by one, carried at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal digits of a limb, and limbs of a number: 81 digits, and 256 bits are 78 at most.
DIGITS, LIMBS = 9, 9
BASE = 10**DIGITS


def limbs(raw: Column, sign: Column | int = 1) -> list[Column]:
    """The limbs of a non-negative number in text, highest first, times a sign. Sums of up to nine thousand million of them fit; text of other than
    1 to 81 digits is null."""
    padded = F.when(raw.rlike(f"^[0-9]{{1,{DIGITS * LIMBS}}}$"), F.lpad(raw, DIGITS * LIMBS, "0"))
    return [F.substring(padded, 1 + DIGITS * k, DIGITS).cast("long") * sign for k in range(LIMBS)]


def _carried(parts: Column) -> Column:
    """(carry, out): limbs of 0 to BASE - 1 and what is left above the highest, which is negative just if the number is."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
    low = lambda a, x: F.pmod(x + a["carry"], F.lit(BASE).cast("long"))
    high = lambda a, x: F.floor((x + a["carry"] - low(a, x)).cast("decimal(20,0)") / F.lit(BASE).cast("decimal(10,0)")).cast("long")
    return F.aggregate(F.reverse(parts), start, lambda a, x: F.struct(high(a, x).alias("carry"), F.concat(F.array(low(a, x)), a["out"]).alias("out")))


def to_text(sums: list[Column]) -> Column:
    """Sums of limbs, of either sign, as exact decimal text."""
    parts = F.array(*sums)
    plus, minus = _carried(parts), _carried(F.transform(parts, lambda x: -x))
    negative = plus["carry"] < 0
    right = F.when(negative, minus).otherwise(plus)
    digits = F.concat(right["carry"].cast("string"), F.array_join(F.transform(right["out"], lambda x: F.lpad(x.cast("string"), DIGITS, "0")), ""))
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(negative, F.concat(F.lit("-"), short)).otherwise(short)
