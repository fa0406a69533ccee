"""Whole numbers of any width as strings of decimal digits, by column functions alone: limbs of six digits in arrays,
lowest first.  A limb product is below 10^12, so sums of millions of them stay inside 64 bits.

Strings hold digits with a leading minus at most; null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6
UNIT = 10**DIGITS


def limbs(digits: Column) -> Column:
    plain = F.regexp_replace(digits, "^-", "")
    padded = F.lpad(plain, (F.ceil(F.length(plain) / DIGITS) * DIGITS).cast("int"), F.lit("0"))
    return F.reverse(F.transform(F.regexp_extract_all(padded, F.lit("." * DIGITS), F.lit(0)), lambda x: x.cast("long")))


def carried(columns: Column) -> Column:
    """Limbs below UNIT from sums of limb products; a limb borrowed from is made good by the next."""
    start = F.struct(F.lit(0).cast("long").alias("over"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        total = s["over"] + x
        low = F.pmod(total, F.lit(UNIT))
        return F.struct(F.floor((total - low) / UNIT).cast("long").alias("over"), F.array_append(s["out"], low).alias("out"))

    return F.aggregate(F.concat(columns, F.array_repeat(F.lit(0).cast("long"), 3)), start, step, lambda s: s["out"])


def text(limbs_: Column, negative: Column) -> Column:
    digits = F.regexp_replace(F.array_join(F.transform(F.reverse(limbs_), lambda x: F.lpad(x.cast("string"), DIGITS, F.lit("0"))), ""), "^0+", "")
    return F.when(digits == "", "0").when(negative, F.concat(F.lit("-"), digits)).otherwise(digits)


def negative(digits: Column) -> Column:
    return digits.startswith("-")


def product(a: Column, b: Column) -> Column:
    x, y = limbs(a), limbs(b)
    places = F.sequence(F.lit(0), F.size(x) + F.size(y) - 2)
    column = lambda k: F.aggregate(F.sequence(F.greatest(F.lit(0), k - F.size(y) + 1), F.least(k, F.size(x) - 1)), F.lit(0).cast("long"), lambda s, i: s + F.get(x, i) * F.get(y, k - i))
    return text(carried(F.transform(places, column)), negative(a) != negative(b))


def sum_of(a: Column, b: Column) -> Column:
    """a + b of numbers that aren't negative."""
    return text(carried(F.zip_with(limbs(a), limbs(b), lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))), F.lit(False))


def compare(a: Column, b: Column) -> Column:
    """1, 0 or -1 of numbers that aren't negative and have no leading zeros."""
    longer = F.length(a) - F.length(b)
    return F.when(longer > 0, 1).when(longer < 0, -1).when(a > b, 1).when(a < b, -1).otherwise(0)
