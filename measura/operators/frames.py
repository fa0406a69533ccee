"""Cells of frames: connected components and matchings between frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.operators.graph import components


def components_of_cells(cells: DataFrame, key: str, frame: list[str], axes: list[str]) -> DataFrame:
    """cells with root: the smallest key that steps of one along an axis reach inside the frame.

    Neighbours are found by an equality join on the cell moved by one, an axis at a time.
    """
    moved = None
    for axis in axes:
        there = cells.select(*frame, *((F.col(a) + (1 if a == axis else 0)).alias(a) for a in axes), F.col(key).alias("a"))
        found = there.join(cells.select(*frame, *axes, F.col(key).alias("b")), [*frame, *axes]).select("a", "b")
        moved = found if moved is None else moved.unionByName(found)
    tied = components(moved).withColumnRenamed("node", key)
    return cells.join(tied, key, "left").withColumn("root", F.coalesce("root", key))


def best_assignment(pairs: pd.DataFrame) -> pd.DataFrame:
    """A matching of the largest total weight among (a, b, weight): augmenting paths of the largest gain, one at a time.

    Of equal gains the path found first in the order of the pairs is taken, so the result is determined.
    """
    best: dict[tuple[int, int], int] = {}
    for a, b, w in sorted(zip(pairs["a"], pairs["b"], pairs["weight"], strict=True)):
        best[(a, b)] = max(w, best.get((a, b), w))
    lefts = sorted({a for a, _ in best})
    chosen: dict[int, int] = {}  # right -> left
    while True:
        gain = {("l", a): 0 for a in lefts if a not in chosen.values()}
        came: dict[tuple[str, int], tuple[str, int]] = {}
        for _ in range(len(lefts) + len(best)):
            changed = False
            for (a, b), w in best.items():
                left, right = ("l", a), ("r", b)
                if left in gain and chosen.get(b) != a and gain[left] + w > gain.get(right, -(1 << 60)):
                    gain[right], came[right], changed = gain[left] + w, left, True
            for b, a in chosen.items():
                left, right = ("l", a), ("r", b)
                if right in gain and gain[right] - best[(a, b)] > gain.get(left, -(1 << 60)):
                    gain[left], came[left], changed = gain[right] - best[(a, b)], right, True
            if not changed:
                break
        ends = [(g, -n[1]) for n, g in gain.items() if n[0] == "r" and n[1] not in chosen]
        if not ends or max(ends)[0] <= 0:
            break
        at = ("r", -max(ends)[1])
        while at in came:
            left = came[at]
            chosen[at[1]] = left[1]
            if left not in came:
                break
            at = came[left]
    rows = [(a, b, best[(a, b)]) for b, a in sorted(chosen.items())]
    return pd.DataFrame(rows, columns=["a", "b", "weight"])


def heaviest_matching(pairs: DataFrame, frame: list[str]) -> DataFrame:
    """(frame, a, b, weight): a heaviest matching of each frame's pairs, each connected component in a task of its own."""
    node = lambda side: F.xxhash64(*frame, F.lit(side), F.col(side))
    keyed = pairs.select(*frame, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("long").alias("weight"), node("a").alias("na"), node("b").alias("nb"))
    roots = components(keyed, "na", "nb").withColumnRenamed("node", "na")
    schema = T.StructType([*pairs.select(*frame).schema.fields, T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("weight", T.LongType())])

    def solve(batches: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        out = best_assignment(batches)
        for c in reversed(frame):
            out.insert(0, c, batches[c].iloc[0])
        return out

    return keyed.join(roots, "na").groupBy("root").applyInPandas(solve, schema)
