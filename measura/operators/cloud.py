"""Nearest neighbours of points with whole coordinates, by buckets that widen, and what their directions add up to.

Points of equal places are one place with its ids.  A place looks for its nearest other place in the buckets around its own;
whatever lies outside these is further away than a bucket's side, so a neighbour within that distance is the nearest.  Places
without one go on with buckets of twice the side.  A place that is still looking has no neighbour within the side before, so
few of them are left where places are dense, and no pair of all points is made.  The first side is halved until a place shares
its bucket with about one other, so that what a place meets doesn't grow with the number of places.

Edge cases: rows with a null id or coordinate are left out; a place that several ids hold is its own nearest at distance 0;
ties go to the neighbour with the smallest id; a single point has no neighbour and no row.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measura.operators.lanes import with_lanes
from measura.session import drop_materialized, materialize


def squared(a: str, b: str, axes: list[str]) -> Column:
    return sum(((F.col(f"{b}.{c}") - F.col(f"{a}.{c}")) * (F.col(f"{b}.{c}") - F.col(f"{a}.{c}")) for c in axes), F.lit(0))


CROWD = 2  # places, itself among them, that a place may find in its first bucket on the average


def first_side(places: DataFrame, axes: list[str], side: int) -> int:
    """The largest of side, side / 2, ... at which a place's bucket holds CROWD places or fewer on the average."""
    while side > 1:
        held = places.groupBy(*(F.floor(F.col(c) / side).alias(c) for c in axes)).agg(F.count("*").alias("n"))
        met = held.agg(F.sum(F.col("n") * F.col("n")).alias("met"), F.sum("n").alias("n")).first()
        if not met["n"] or met["met"] <= CROWD * met["n"]:
            break
        side //= 2
    return side


def nearest(points: DataFrame, axes: list[str], key: str = "id", side: int = 64) -> DataFrame:
    """(id, nearest, distance, axes): the nearest other point of every point, its squared distance and the step to it."""
    spark = points.sparkSession
    known = points.select(F.col(key).alias("id"), *axes).dropna()
    places = materialize(known.groupBy(*axes).agg(F.min("id").alias("id"), F.count_distinct("id").alias("ids")), "cloud-places")
    open_, found = materialize(places.select("id", *axes), "cloud-open"), None
    several = places.count() > 1
    side = first_side(places, axes, side)
    while several and not open_.isEmpty():
        bucket = lambda shift: [(F.floor(F.col(c) / side) + d).alias(f"b{i}") for i, (c, d) in enumerate(zip(axes, shift, strict=True))]  # noqa: B023, E731
        near = F.explode(F.array(*(F.struct(*bucket(s)) for s in product((-1, 0, 1), repeat=len(axes)))))
        asked = open_.select("*", near.alias("b")).select("id", *axes, "b.*").alias("p")
        held = places.select("id", *axes, *bucket((0,) * len(axes))).alias("q")
        on = [F.col(f"p.b{i}") == F.col(f"q.b{i}") for i in range(len(axes))]
        pair = asked.join(held, on).where("p.id <> q.id").select(F.col("p.id").alias("id"), squared("p", "q", axes).alias("distance"), F.col("q.id").alias("nearest"), *((F.col(f"q.{c}") - F.col(f"p.{c}")).alias(c) for c in axes))
        best = pair.groupBy("id").agg(F.min(F.struct("distance", "nearest", *axes)).alias("m")).where(F.col("m.distance") <= side * side)
        done = materialize(best.select("id", "m.*"), "cloud-done")
        found = done if found is None else found.unionByName(done)
        left = materialize(open_.join(done, "id", "left_anti"), "cloud-open")
        drop_materialized(spark, open_)
        open_, side = left, side * 2
    # The smallest id of a place with several is its others' neighbour, and has the next one.
    alike = known.join(places.where("ids > 1").select(*axes, F.col("id").alias("least")), axes)
    second = alike.where("id > least").groupBy("least").agg(F.min("id").alias("next"))
    same = alike.select("id", "least").distinct().join(second, "least")
    same = same.select("id", F.when(F.col("id") == F.col("least"), F.col("next")).otherwise(F.col("least")).alias("nearest"), F.lit(0).cast("long").alias("distance"), *(F.lit(0).cast("long").alias(c) for c in axes))
    columns = ["id", "nearest", "distance", *axes]
    return same if found is None else found.join(places.where("ids = 1").select("id"), "id", "left_semi").select(*columns).unionByName(same.select(*columns))


def tensor(steps: DataFrame, axes: list[str]) -> DataFrame:
    """One row: points, the sum of squared distances, and the sums of products of the steps' components."""
    products = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return steps.agg(F.count("*").alias("points"), F.sum("distance").alias("distance"), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in products))


def shuffled(points: DataFrame, axes: list[str], key: str = "id", seed: int = 1) -> DataFrame:
    """The points with every axis but the first dealt anew, by the order of a hash: each axis keeps its values, and what they had to
    do with one another is lost."""
    out = with_lanes(points.select(key, axes[0]), [key], "place")
    for axis in axes[1:]:
        dealt = points.select(F.col(axis), F.col(key).alias("__key"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(axis), F.col(key).cast("string"))).alias("__order"))
        out = out.join(with_lanes(dealt, ["__order", "__key"], "place").select("place", axis), "place")
    return out.drop("place")
