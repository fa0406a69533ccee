"""Periods of lattices on every axis, each beside the periods of the same lines with their places dealt anew.

A lag's agreement is the number of places whose value stands again one lag further along the axis, over the places that have all
lags.  A peak is a lag whose agreement is above both neighbours' and whose double is a peak too; its height is the smaller of
the two rises.  The null shuffles the places inside every line by a hash of (draw, frame, axis, line, place): it keeps each
line's values and loses their order.  All draws are one pass: a sort of the lines by draw, and one window with every lag.  A
period counts if its height is above the greatest height of all draws: whole numbers over the same pairs, so the
comparison is exact.

Edge cases: lines are read by place, without regard to gaps; values are compared as they are, null with nothing; a line shorter
than its frame's extent adds the pairs it has.  Axes shorter than ``2 * 2 + 1`` lags have no peak, and no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def lines(cells: DataFrame, frame: str, axes: list[str], value: str) -> DataFrame:
    """(frame, axis, line, place, v): every cell once for each axis, in the line along it."""
    along = [F.struct(F.lit(a).alias("axis"), F.concat_ws(":", *(F.col(b) for b in axes if b != a)).alias("line"), F.col(a).alias("place")) for a in axes]
    return cells.select(F.col(frame).alias("frame"), F.col(value).alias("v"), F.explode(F.array(*along)).alias("l")).select("frame", "l.axis", "l.line", "l.place", "v")


def dealt(rows: DataFrame, draws: int) -> DataFrame:
    """rows with ``draw``: 0 as they are, 1 to ``draws`` with the places of every line dealt anew."""
    every = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    key = F.md5(F.concat_ws(":", "draw", "frame", "axis", "line", "place"))
    order = W.partitionBy("draw", "frame", "axis", "line").orderBy(key, "place")
    return every.withColumn("place", F.when(F.col("draw") == 0, F.col("place")).otherwise(F.row_number().over(order) - 1))


def agreements(rows: DataFrame, lags: int, extent: int) -> DataFrame:
    """(draw, frame, axis, same): the agreement of every lag up to ``lags``, as an array, over the places with all lags."""
    order = W.partitionBy("draw", "frame", "axis", "line").orderBy("place")
    again = [F.when((F.col("place") < extent - lags) & (F.lead("v", k).over(order) == F.col("v")), 1).otherwise(0).alias(f"a{k}") for k in range(1, lags + 1)]
    return rows.select("draw", "frame", "axis", *again).groupBy("draw", "frame", "axis").agg(*(F.sum(f"a{k}").alias(f"a{k}") for k in range(1, lags + 1))).select("draw", "frame", "axis", F.array(*(f"a{k}" for k in range(1, lags + 1))).alias("same"))


def best_peak(same: Column, lags: int) -> Column:
    """(height, period) of the highest peak (ties: the shorter period); null without one."""
    at = lambda k: F.get(same, k - 1)
    rise = lambda k: at(k) - F.greatest(at(k - 1), at(k + 1))
    peaks = [F.when((rise(p) > 0) & (rise(2 * p) > 0), F.struct(F.least(rise(p), rise(2 * p)).alias("height"), F.lit(-p).alias("minus"))) for p in range(2, (lags - 1) // 2 + 1)]
    return F.greatest(*peaks, F.lit(None), F.lit(None)) if peaks else F.lit(None).cast("struct<height:bigint,minus:int>")


def periods(cells: DataFrame, frame: str, axes: list[str], value: str, lags: int, extent: int, draws: int = 19) -> DataFrame:
    """(frame, axis, period, height, band, beyond) of every frame and axis: null and 0 without a peak; band is the greatest height
    of the draws.  With ``draws`` of 19, a lattice without order passes by chance once in twenty."""
    found = agreements(dealt(lines(cells, frame, axes, value), draws), lags, extent).withColumn("peak", best_peak(F.col("same"), lags))
    of = found.withColumn("height", F.coalesce("peak.height", F.lit(0)))
    out = of.groupBy("frame", "axis").agg(
        F.max(F.when(F.col("draw") == 0, -F.col("peak.minus"))).cast("long").alias("period"),
        F.max(F.when(F.col("draw") == 0, F.col("height"))).alias("height"),
        F.coalesce(F.max(F.when(F.col("draw") > 0, F.col("height"))), F.lit(0)).alias("band"),
    )
    return out.withColumn("beyond", F.col("height") > F.col("band"))
