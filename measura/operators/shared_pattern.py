"""Root boxes and noise ladders: what a box of a lattice shares along its axes, and how the noise of places grows with their level.

Root box: a term names the axes that a pattern keeps; the pattern holds, for each of its places, the mean (rounded down) of the
box's lanes that share it, and the residual is what is left.  Box, residual and pattern are priced by their bits after lifting
and coding (see measura.functions.tower and coding); the term that saves most is the box's root, the first of equal ones, and none
where nothing is saved.  Residual and pattern give the box back.

Noise ladder: a place's frames are cut into blocks; a block's cumulants of order 2 to 4 (k-statistics, kept as whole numerators) stand
beside the sum of the place's other blocks, its level without itself.  Lines through these are fitted from sums that add up, so
blocks may be anywhere; the slopes are compared as whole numbers: rising where s3 >= s2^2, convex where s2 s4 >= s3^2.

Edge cases: boxes are cut at the extents; absent places are 0; frames beyond the last whole block are left out; a frame count of
less than two blocks has no ladder; a level that never changes leaves the tests false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measura.functions import coding, tower
from measura.operators import crystal

#: Axes that a term's pattern keeps, by the axes' numbers: every choice but all of them.
TERMS = tuple(kept for n in range(len(crystal.AXES)) for kept in combinations(range(len(crystal.AXES)), n))
WIDE = "decimal(38,0)"


def price(values: np.ndarray, levels: int) -> int:
    return coding.pack(coding.zigzag(tower.lift(values, levels).ravel()))[1]


def pattern(values: np.ndarray, kept: tuple[int, ...]) -> np.ndarray:
    """Means over the axes that aren't kept, rounded down, in an array that spreads over the box."""
    gone = tuple(a for a in range(values.ndim) if a not in kept)
    return values.sum(gone, keepdims=True) // int(np.prod([values.shape[a] for a in gone]))


def root(values: np.ndarray, levels: int) -> tuple[int, int, int]:
    """(root, bits of the box, bits saved); -1 and 0 where no term saves any."""
    whole, best, saved = price(values, levels), -1, 0
    for term, kept in enumerate(TERMS):
        shared = pattern(values, kept)
        gain = whole - price(values - shared, levels) - price(shared, levels)
        if gain > saved:
            best, saved = term, gain
    return best, whole, saved


ROOTS = "sample long, bt int, by int, bx int, root long, box_bits long, saved long, residual binary, pattern binary"


def rooting(extents: tuple[int, ...], blocks: tuple[int, ...], levels: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        place, lanes, _, _ = crystal.filled(group, "lane", extents, blocks, 0)
        term, bits, saved = root(lanes, levels)
        shared = pattern(lanes, TERMS[term]) if term >= 0 else np.zeros((1,) * lanes.ndim, np.int64)
        row = [group["sample"][0].as_py(), *place, term, bits, saved, (lanes - shared).astype("<i8").tobytes(), shared.astype("<i8").tobytes()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in ROOTS.split(", ")])

    return run


def roots(cells: DataFrame, extents: tuple[int, ...], blocks: tuple[int, ...], levels: int) -> DataFrame:
    """(ROOTS) of every box of (sample, t, y, x, lane)."""
    rows = crystal.bordered(cells, "lane", extents, blocks, 0)
    return rows.groupBy("sample", *(f"b{a}" for a in crystal.AXES)).applyInArrow(rooting(extents, blocks, levels), ROOTS)


def returned(found: DataFrame, extents: tuple[int, ...], blocks: tuple[int, ...]) -> DataFrame:
    """(sample, t, y, x, lane): the lattice of roots()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = tuple(row[f"b{a}"] for a in crystal.AXES)
                shape = [min(n, (i + 1) * b) - i * b for i, b, n in zip(place, blocks, extents, strict=True)]
                kept = TERMS[row["root"]] if row["root"] >= 0 else ()
                shared = np.frombuffer(row["pattern"], "<i8").reshape([n if a in kept else 1 for a, n in enumerate(shape)])
                values = np.frombuffer(row["residual"], "<i8").reshape(shape) + shared
                at = np.indices(shape).reshape(len(shape), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(values.size, row["sample"])), *(pa.array(p + i * b) for p, i, b in zip(at, place, blocks, strict=True)), pa.array(values.ravel())], names=["sample", *crystal.AXES, "lane"])

    return found.mapInArrow(run, "sample long, t long, y long, x long, lane long")


def ladder(cells: DataFrame, frames: int, block: int) -> DataFrame:
    """(sample, blocks, rising, convex) and, for each order, slope, intercept and their denominator as text, of dense (sample, t, y, x,
    lane) with ``frames`` frames."""
    n, whole = block, frames // block
    v = F.col("lane").cast("decimal(10,0)")
    powers = [F.sum(v.cast(WIDE)), F.sum((v * v).cast(WIDE)), F.sum((v * v * v).cast(WIDE)), F.sum((v * v * v * v).cast(WIDE))]
    parts = cells.where(F.col("t") < whole * block).groupBy("sample", "y", "x", F.floor(F.col("t") / block).alias("part")).agg(*(p.alias(f"s{k}") for k, p in enumerate(powers, 1)))
    total = parts.groupBy("sample", "y", "x").agg(F.sum("s1").alias("total"))
    wide = lambda e: F.expr(f"CAST({e} AS {WIDE})")
    both = parts.join(total, ["sample", "y", "x"]).select(
        "sample",
        (F.col("total") - F.col("s1")).cast(WIDE).alias("level"),
        wide(f"{n} * s2 - s1 * s1").alias("k2"),
        wide(f"2 * s1 * s1 * s1 - {3 * n} * s1 * s2 + {n * n} * s3").alias("k3"),
        wide(f"{n * n * (n + 1)} * s4 - {4 * n * (n + 1)} * s1 * s3 - {3 * n * (n - 1)} * s2 * s2 + {12 * n} * s1 * s1 * s2 - 6 * s1 * s1 * s1 * s1").alias("k4"),
    )
    orders = ("k2", "k3", "k4")
    sums = both.groupBy("sample").agg(
        F.count("*").alias("blocks"), F.sum("level").cast(WIDE).alias("x"), F.sum((F.col("level") * F.col("level")).cast(WIDE)).alias("xx"),
        *(F.sum(k).cast(WIDE).alias(k) for k in orders), *(F.sum((F.col("level") * F.col(k)).cast(WIDE)).alias(f"x{k}") for k in orders),
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                r = {c: int(x) for c, x in r.items()}
                den = r["blocks"] * r["xx"] - r["x"] ** 2
                slope = {k: r["blocks"] * r[f"x{k}"] - r["x"] * r[k] for k in orders}
                rest = {k: r[k] * r["xx"] - r["x"] * r[f"x{k}"] for k in orders}
                # Numerators are over falling factorials of the block, levels are sums of the other frames: common factors of a
                # fitted slope that the tests take along.
                f2, f3, f4 = n * (n - 1), n * (n - 1) * (n - 2), n * (n - 1) * (n - 2) * (n - 3)
                scale = (whole - 1) * n
                s2, s3, s4 = (slope[k] * scale for k in orders)
                rising = den > 0 and s3 * den * f2 * f2 >= s2 * s2 * f3
                convex = den > 0 and s2 * s4 * f3 * f3 >= s3 * s3 * f2 * f4
                out.append({"sample": r["sample"], "blocks": r["blocks"], "rising": rising, "convex": convex, "denominator": str(den)} | {f"slope{k[1]}": str(slope[k]) for k in orders} | {f"intercept{k[1]}": str(rest[k]) for k in orders})
            names = [("sample", pa.int64()), ("blocks", pa.int64()), ("rising", pa.bool_()), ("convex", pa.bool_()), ("denominator", pa.string()), *((f"slope{k[1]}", pa.string()) for k in orders), *((f"intercept{k[1]}", pa.string()) for k in orders)]
            yield pa.RecordBatch.from_pylist(out, pa.schema(names))

    return sums.mapInArrow(fit, "sample long, blocks long, rising boolean, convex boolean, denominator string, slope2 string, slope3 string, slope4 string, intercept2 string, intercept3 string, intercept4 string") if whole >= 2 else cells.sparkSession.createDataFrame([], "sample long, blocks long, rising boolean, convex boolean, denominator string, slope2 string, slope3 string, slope4 string, intercept2 string, intercept3 string, intercept4 string")
