"""Exact sequences by folds over arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grundy(spark: SparkSession, moves: tuple[int, ...], heaps: int) -> DataFrame:
    """(heap, grundy): the least value that no move leads to, by a fold over heaps; an array of ``heaps`` values."""
    start = F.array().cast("array<bigint>")

    def step(seq, heap):
        after = F.transform(F.filter(F.array(*(F.lit(m) for m in moves)), lambda m: m <= heap), lambda m: F.get(seq, (heap - m).cast("int")))
        free = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(len(moves)).cast("long")), lambda g: ~F.array_contains(after, g))
        return F.array_append(seq, F.array_min(free))

    values = F.aggregate(F.sequence(F.lit(0), F.lit(heaps - 1)), start, step)
    return spark.range(1).select(F.posexplode(values).alias("heap", "grundy")).select(F.col("heap").cast("long").alias("heap"), "grundy")
