"""Exact whole-number functions of columns: ratios, divisors, bands, codes and curves.

A ratio is a struct of a numerator and a positive denominator; ratios are compared by cross products, never divided.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO = "decimal(38,0)"


def ratio(num: Column, den: Column) -> Column:
    """num/den with a positive denominator; a zero denominator fails the query."""
    sign = F.when(den < 0, -1).otherwise(1)
    checked = F.when(den == 0, F.raise_error(F.lit("zero denominator"))).otherwise(den)
    return F.struct((num * sign).cast(RATIO).alias("num"), (checked * sign).cast(RATIO).alias("den"))


def ratio_compare(a: Column, b: Column) -> Column:
    """1, 0 or -1 as a is above, at or below b."""
    left, right = a["num"].cast("decimal(19,0)") * b["den"].cast("decimal(19,0)"), b["num"].cast("decimal(19,0)") * a["den"].cast("decimal(19,0)")
    return F.when(left > right, 1).when(left < right, -1).otherwise(0)


def ratio_sum(a: Column, b: Column) -> Column:
    short = lambda c: c.cast("decimal(18,0)")
    num = short(a["num"]) * short(b["den"]) + short(b["num"]) * short(a["den"])
    return F.struct(num.cast(RATIO).alias("num"), (short(a["den"]) * short(b["den"])).cast(RATIO).alias("den"))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, folded: 93 rounds are enough for two 64-bit values."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda s: F.struct(s["b"].alias("a"), F.when(s["b"] == 0, s["a"]).otherwise(s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(step(s)), lambda s: s["a"])


def reduced(num: Column, den: Column) -> Column:
    """ratio() in lowest terms, of 64-bit values."""
    by = F.greatest(gcd(num, den), F.lit(1))
    return ratio(_div(num, by), _div(den, by))


def _div(a: Column, b: Column) -> Column:
    return ((a - a % b).cast("decimal(19,0)") / b.cast("decimal(19,0)")).cast("long")


def ladder_rungs(most: int = 80) -> list[int]:
    """The Fibonacci ladder from 1, 1."""
    rungs = [1, 1]
    while len(rungs) < most:
        rungs.append(rungs[-1] + rungs[-2])
    return rungs


def band(value: Column, rungs: int = 60) -> Column:
    """How many rungs a value reaches, with its sign."""
    line = F.array(*(F.lit(r).cast("long") for r in ladder_rungs(rungs)))
    return F.sign(value).cast("long") * F.size(F.filter(line, lambda r: r <= F.abs(value)))


def zigzag(value: Column) -> Column:
    """0, -1, 1, -2, 2 ... as 0, 1, 2, 3, 4 ..."""
    return F.when(value >= 0, 2 * value).otherwise(-2 * value - 1)


def gray(value: Column) -> Column:
    return value.bitwiseXOR(F.shiftright(value, 1))


def morton(x: Column, y: Column, bits: int) -> Column:
    """Bits of x and y interleaved, x lowest."""
    total = F.lit(0).cast("long")
    for k in range(bits):
        total = total + F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)).cast("long"), 2 * k) + F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)).cast("long"), 2 * k + 1)
    return total


def wrapped(value: Column, bits: int) -> Column:
    """The low bits as a signed value."""
    half = 1 << (bits - 1)
    return F.pmod(value + half, F.lit(2 * half)) - half


def lower_median(values: Column) -> Column:
    """The middle of an array, the lower of two; null if it is empty."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) / 2).cast("int"))
