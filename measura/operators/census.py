"""Symbol censuses: how often each symbol occurs in each unit, and what follows from the counts alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 256  # rows whose symbols are held at once


def counted(key: str, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, sym, n, first_pos) of each row's own symbols: a text leaves as its distinct symbols, not as its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                symbols, counts, firsts, size = [], [], [], []
                for body in part[text].to_pylist():
                    points = np.frombuffer((body or "").encode("utf-32-le", "surrogatepass"), "<u4")
                    found, first, n = np.unique(points, return_index=True, return_counts=True)
                    symbols += map(chr, found.tolist())
                    counts.append(n)
                    firsts.append(first)
                    size.append(len(found))
                keys = part[key].take(pa.array(np.repeat(np.arange(len(part)), size)))
                whole = lambda x: pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([keys, pa.array(symbols, pa.string()), whole(counts), whole(firsts)], names=[key, "sym", "n", "first_pos"])

    return run


def row_census(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sym, n, first_pos): occurrences of each code point in each row and the first of its places; null and empty texts give
    none."""
    kind = T.StructType([df.schema[key], T.StructField("sym", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first_pos", T.LongType())])
    return df.select(key, text).mapInArrow(counted(key, text), kind)


def census(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sym, n): occurrences of each symbol in each unit."""
    return row_census(df, key, text).groupBy(key, "sym").agg(F.sum("n").alias("n"))


def collision_terms() -> list[Column]:
    return [F.sum("n").alias("total"), F.count("*").alias("distinct_syms"), F.sum(F.col("n") * F.col("n")).alias("sum_sq")]


def collision_census(df: DataFrame, key: str, text: str) -> DataFrame:
    """Totals, distinct symbols and the sum of squared counts; prefers_free compares the collision rate with 85 % of
    a uniform one by cross-multiplication, so no division rounds."""
    out = census(df, key, text).groupBy(key).agg(*collision_terms())
    return out.withColumn("prefers_free", 100 * F.col("total") * F.col("total") < 85 * F.col("distinct_syms") * F.col("sum_sq"))
