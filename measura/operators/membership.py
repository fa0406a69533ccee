"""Explicit Bloom filters as tables of set bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Start and multiplier of the 32-bit FNV-1a hash. Fixed values.
START, PRIME = 2166136261, 16777619


def fnv1a(text: Column, seed: int) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, from a seeded start."""
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(START + seed).cast("long") % (1 << 32), lambda h, b: (h.bitwiseXOR(b) * PRIME) % (1 << 32))


def slots(text: Column, hashes: int, bits: int) -> Column:
    """The bits of a value: two hashes, combined."""
    a, b = fnv1a(text, 0), fnv1a(text, 1)
    return F.array_distinct(F.array(*((a + i * b) % bits for i in range(hashes))))


def build(values: DataFrame, column: str, hashes: int, bits: int) -> DataFrame:
    """(bit): the bits that any value sets; each distinct value is hashed once."""
    return values.select(column).distinct().select(F.explode(slots(F.col(column), hashes, bits)).alias("bit")).distinct()


def contains(values: DataFrame, column: str, filter_bits: DataFrame, hashes: int, bits: int) -> DataFrame:
    """values with maybe: whether all of a value's bits are set; false is sure."""
    asked = values.select(F.col(column)).distinct().withColumn("bits", slots(F.col(column), hashes, bits))
    hit = asked.select(column, F.size("bits").alias("need"), F.explode("bits").alias("bit")).join(filter_bits, "bit").groupBy(column, "need").agg(F.count("*").alias("have"))
    return values.join(hit.where("have = need").select(column, F.lit(True).alias("maybe")), column, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
