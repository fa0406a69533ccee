"""Counts over the places of a text, made inside its row: a text leaves its task as counts, never as its characters.

A unit is a key; where several rows hold one key, what doesn't add up over rows (distinct blocks, a middle) is put together
by a shuffle of these rows' blocks alone.  Edge cases: null and empty texts have no places and give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.session import materialize

POINT_BITS = 21
ROWS = 64  # rows whose texts are Python objects at once
BROADCAST_ROWS = 1_000_000

Made = Callable[[str], list[np.ndarray]]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def blocks(codes: np.ndarray, width: int) -> np.ndarray:
    """The number of the block that begins at every place but the last ones."""
    n = max(len(codes) - width + 1, 0)
    out = np.zeros(n, np.int64)
    for k in range(width):
        out = out << POINT_BITS | codes[k : k + n]
    return out


def rows_of(df: DataFrame, keys: list[str], text: str, made: Callable[..., list[np.ndarray]], columns: dict[str, T.DataType], *more: str) -> DataFrame:
    """The keys and columns of the rows that ``made`` gives for each text that isn't empty; it gets the columns ``more`` besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                found = [made(body, *rest) if body else [np.zeros(0)] * len(columns) for body, *rest in zip(*(part[c].to_pylist() for c in (text, *more)), strict=True)]
                places = pa.array(np.repeat(np.arange(len(part)), [len(f[0]) for f in found]))
                values = [pa.array(np.concatenate([f[i] for f in found]).astype(np.float64 if k == T.DoubleType() else np.int64), kinds[k]) for i, k in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([*(part[c].take(places) for c in keys), *values], names=[*keys, *columns])

    schema = T.StructType([*(df.schema[c] for c in keys), *(T.StructField(c, k) for c, k in columns.items())])
    return df.select(*dict.fromkeys([*keys, text, *more])).mapInArrow(run, schema)


def octet_pair_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pair, n): neighbouring UTF-8 bytes of each row, as first * 256 + second."""

    def made(body: str) -> list[np.ndarray]:
        octets = np.frombuffer(body.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        return list(np.unique(octets[:-1] * 256 + octets[1:], return_counts=True))

    return rows_of(df, [key], text, made, {"pair": T.LongType(), "n": T.LongType()})


def parted(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the others; None if there are none."""
    twice = materialize(df.groupBy(F.col(key).alias("__twice")).agg(F.count("*").alias("n")).where("n > 1").select("__twice"), "in-row-twice")
    count = twice.count()
    if not count:
        return df, None
    held = F.broadcast(twice) if count <= BROADCAST_ROWS else twice
    same = F.col(key).eqNullSafe(F.col("__twice"))
    return df.join(held, same, "left_anti"), df.join(held, same, "left_semi")


def block_kinds(df: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """(key, k1, k2, ...): how many different blocks of one, two, ... code points each key's rows hold."""
    names = [f"k{k}" for k in range(1, most + 1)]
    alone, several = parted(df, key)
    own = lambda body: [np.array([len(np.unique(blocks(p, k)))]) for p in (points(body),) for k in range(1, most + 1)]
    out = rows_of(alone, [key], text, own, {c: T.LongType() for c in names})
    if several is None:
        return out

    def every(body: str) -> list[np.ndarray]:
        found = [np.unique(blocks(points(body), k)) for k in range(1, most + 1)]
        return [np.repeat(np.arange(1, most + 1), [len(f) for f in found]), np.concatenate(found)]

    kinds = rows_of(several, [key], text, every, {"k": T.LongType(), "block": T.LongType()}).distinct().groupBy(key)
    return out.unionByName(kinds.agg(*(F.sum((F.col("k") == k).cast("long")).alias(c) for k, c in enumerate(names, 1))))


def entropy(n: np.ndarray) -> np.ndarray:
    share = n / n.sum() if len(n) else n
    return -np.sum(share * np.log2(share), keepdims=True) if len(n) else np.zeros(0)


def pair_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bits): the entropy of the pairs of neighbouring code points of each key's rows, if there are any."""
    alone, several = parted(df, key)
    out = rows_of(alone, [key], text, lambda body: [entropy(np.unique(blocks(points(body), 2), return_counts=True)[1])], {"bits": T.DoubleType()})
    if several is None:
        return out
    pairs = rows_of(several, [key], text, lambda body: list(np.unique(blocks(points(body), 2), return_counts=True)), {"block": T.LongType(), "n": T.LongType()})
    sums = pairs.groupBy(key, "block").agg(F.sum("n").cast("double").alias("n")).groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    return out.unionByName(sums.select(key, (F.log2("t") - F.col("x") / F.col("t")).alias("bits")))


def half_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sym, a, b): each key's symbols before the middle of its longest text and from there on, as code points."""
    def made(body: str, size: int) -> list[np.ndarray]:
        codes, half = points(body), size // 2
        sym, at = np.unique(codes, return_inverse=True)
        first = np.bincount(at[:half], minlength=len(sym))
        return [sym, first, np.bincount(at, minlength=len(sym)) - first]

    longest = df.groupBy(key).agg(F.max(F.char_length(text)).cast("long").alias("size"))
    out = rows_of(df.select(key, text).join(longest, key), [key], text, made, {"sym": T.LongType(), "a": T.LongType(), "b": T.LongType()}, "size")
    return out.groupBy(key, "sym").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def half_distance(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, numerator, denominator): the distance between the symbols' shares in the two halves of each key's text; no row for a null key."""
    alone, several = parted(df.where(F.col(key).isNotNull()), key)

    def made(body: str) -> list[np.ndarray]:
        codes = points(body)
        half = len(codes) // 2
        sym, at = np.unique(codes, return_inverse=True)
        a = np.bincount(at[:half], minlength=len(sym))
        b = np.bincount(at, minlength=len(sym)) - a
        return [np.array([np.abs(a * (len(codes) - half) - b * half).sum()]), np.array([2 * half * (len(codes) - half)])]

    out = rows_of(alone, [key], text, made, {"numerator": T.LongType(), "denominator": T.LongType()})
    if several is None:
        return out
    counts = half_counts(several, key, text)
    sums = counts.groupBy(key).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    far: Column = F.abs(F.col("a") * F.col("tb") - F.col("b") * F.col("ta"))
    return out.unionByName(counts.join(sums, key).groupBy(key).agg(F.sum(far).alias("numerator"), F.max(2 * F.col("ta") * F.col("tb")).alias("denominator")))
