"""Operators whose state flows along a sequence: one sequence of an Arrow group at a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TEXTS = 64  # rows whose texts are Python objects at once
VALUES = 1_000_000  # values that are transformed at once, or one sequence of more


def match_rate(docs: DataFrame, key: str, text: str, window: int = 256, every: int = 1) -> DataFrame:
    """(key, places, matched): at every ``every``-th place, the length of the shortest string from there that the window
    before it doesn't hold, added up.  Null texts have no places."""

    def matched(body: str) -> int:
        total, known = 0, 0
        for at in range(window, len(body), every):
            behind, most = body[at - window : at], min(len(body) - at, window)
            known = max(0, known - every)  # what is left of the last place's match still lies in this window
            while known < most and body[at : at + known + 1] in behind:
                known += 1
            total += known + 1
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, TEXTS) for a in range(0, len(batch), TEXTS)):
                bodies = [t or "" for t in part[text].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part[key].cast(pa.int64()), pa.array([len(range(window, len(t), every)) for t in bodies], pa.int64()), pa.array([matched(t) for t in bodies], pa.int64())], names=[key, "places", "matched"]
                )

    return docs.select(key, text).mapInArrow(run, f"{key} long, places long, matched long")


def stays(rows: DataFrame, key: str, order: str, value: str, band: int) -> DataFrame:
    """(key, stays, steps): runs that stay within ``band`` of the value they began with."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values(order)[value].to_numpy()
        count, begin = 0, None
        for x in v:
            if begin is None or abs(x - begin) > band:
                count, begin = count + 1, x
        return pd.DataFrame({key: [frame[key].iloc[0]], "stays": [count], "steps": [len(v)]})

    return rows.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} long, stays long, steps long")


def slopes(v: np.ndarray, bands: int) -> np.ndarray:
    """The slope for each row of v, all of one length; not a number where fewer than two bands have power."""
    power = np.abs(np.fft.rfft(v - v.mean(axis=1, keepdims=True), axis=1))[:, 1:] ** 2
    parts = [power[:, (1 << k) - 1 : (1 << (k + 1)) - 1] for k in range(bands)]
    means = np.stack([part.mean(axis=1) if part.shape[1] else np.zeros(len(v)) for part in parts], axis=1)
    held = means > 0
    x, y = np.arange(bands) + 0.5, np.log2(np.where(held, means, 1))
    count = held.sum(axis=1, keepdims=True)
    dx = np.where(held, x - (held * x).sum(axis=1, keepdims=True) / np.maximum(count, 1), 0)
    dy = np.where(held, y - (held * y).sum(axis=1, keepdims=True) / np.maximum(count, 1), 0)
    return np.where(count[:, 0] > 1, (dx * dy).sum(axis=1) / np.maximum((dx * dx).sum(axis=1), 1e-300), np.nan)


def power_exponent(rows: DataFrame, key: str, order: str, value: str, bands: int = 6) -> DataFrame:
    """(key, exponent): slope of log power over log frequency, by least squares over bands of doubling frequency.

    A sequence is one row of a batch; sequences of one length are transformed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            starts, out = np.cumsum(sizes) - sizes, np.full(len(batch), np.nan)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                for some in np.array_split(at, -(-len(at) * int(n) // VALUES)):
                    out[some] = slopes(flat[starts[some][:, None] + np.arange(n)], bands)
            yield pa.RecordBatch.from_arrays([batch[key].cast(pa.int64()), pa.array(out, mask=np.isnan(out))], names=[key, "exponent"])

    placed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v"))))
    sequences = rows.groupBy(key).agg(F.transform(placed, lambda x: x["v"]).alias("v"))
    return sequences.mapInArrow(run, f"{key} long, exponent double")


def hilbert_index(x: Column, y: Column, bits: int) -> Column:
    """Place of a cell on the Hilbert curve of a 2^bits square: an unrolled loop of column expressions."""
    total = F.lit(0).cast("long")
    x, y = x.cast("long"), y.cast("long")
    for level in range(bits - 1, -1, -1):
        side = 1 << level
        rx, ry = F.when(x.bitwiseAND(F.lit(side)) > 0, 1).otherwise(0), F.when(y.bitwiseAND(F.lit(side)) > 0, 1).otherwise(0)
        total = total + F.lit(side * side) * (F.lit(3) * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, side - 1 - x.bitwiseAND(F.lit(side - 1))).otherwise(x.bitwiseAND(F.lit(side - 1))), F.when(flip, side - 1 - y.bitwiseAND(F.lit(side - 1))).otherwise(y.bitwiseAND(F.lit(side - 1)))
        x, y = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
    return total


def average_linkage(names: list[str], distance: np.ndarray) -> list[tuple[str, str, float]]:
    """Merges of average-linkage clustering, nearest first; ties go to the smaller names."""
    groups = {n: [i] for i, n in enumerate(names)}
    merges = []
    while len(groups) > 1:
        d, a, b = min((float(distance[np.ix_(groups[a], groups[b])].mean()), a, b) for a in groups for b in groups if a < b)
        merges.append((a, b, d))
        groups[f"({a} {b})"] = groups.pop(a) + groups.pop(b)
    return merges


def cluster_tree(profiles: DataFrame, name: str, cell: str, share: str) -> DataFrame:
    """(step, a, b, height): the tree of a few named profiles; distances are summed in Spark, the merging is of their
    number only."""
    other = profiles.select(F.col(name).alias("other"), F.col(cell), F.col(share).alias("q"))
    pairs = profiles.join(other, cell)
    shared = pairs.groupBy(name, "other").agg(F.sum(F.col(share) * F.col("q")).alias("dot"))
    self_dot = shared.where(F.col(name) == F.col("other")).select(F.col(name).alias("n"), F.col("dot").alias("own"))
    rows = shared.collect()
    norms = {r["n"]: r["own"] for r in self_dot.collect()}
    names = sorted(norms)
    place = {n: i for i, n in enumerate(names)}
    distance = np.array([[norms[a] + norms[b] for b in names] for a in names])
    for r in rows:
        distance[place[r[name]], place[r["other"]]] -= 2 * r["dot"]
    distance = np.sqrt(np.maximum(distance, 0))
    merges = average_linkage(names, distance)
    return profiles.sparkSession.createDataFrame([(i, a, b, d) for i, (a, b, d) in enumerate(merges)], "step int, a string, b string, height double")


def component_tree(values: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(node, parent, level, cells) of the tree of the upper level sets of a plane.

    Cells are swept from the highest value down (ties: the first place first); where sets meet, the one with the highest top
    goes on and the others end, with the cells they held before.
    """
    height, width = values.shape
    flat = values.ravel()
    order = np.lexsort((np.arange(values.size), -flat))
    step = np.empty(values.size, int)
    step[order] = np.arange(values.size)
    parent, size, seen = np.arange(values.size), np.ones(values.size, int), np.zeros(values.size, bool)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in order.tolist():
        seen[i] = True
        y, x = divmod(i, width)
        near = (i - width if y else -1, i + width if y + 1 < height else -1, i - 1 if x else -1, i + 1 if x + 1 < width else -1)
        sets = sorted({find(j) for j in near if j >= 0 and seen[j]}, key=lambda j: step[j])  # a set's root is its top
        if not sets:
            continue
        top, *ended = sets
        out += [(j, top, int(flat[i]), int(size[j])) for j in ended]
        parent[[i, *ended]] = top
        size[top] += 1 + sum(size[j] for j in ended)
    root = find(int(order[0]))
    return [*out, (root, -1, int(flat.min()), int(size[root]))]


def by_frame(rows: DataFrame, frame: str, of: Callable[[np.ndarray], list[tuple[int, int, int, int]]], side: int) -> DataFrame:
    """An operator on whole planes of side x side cells, one frame in a task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((side, side), np.int64)
        plane[part["y"], part["x"]] = part["lane"]
        return pd.DataFrame([(part[frame].iloc[0], *r) for r in of(plane)], columns=[frame, "node", "parent", "level", "cells"])

    return rows.groupBy(frame).applyInPandas(run, f"{frame} long, node long, parent long, level long, cells long")
