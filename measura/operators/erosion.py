"""Erosion of sets of cells: how many layers lie between a cell and the outside.

Each round takes the cells off that lack a neighbour on any axis; a cell's width is the round that takes it.  Neighbours are
found by equality joins on the cell moved by one, so frames may be of any size; the number of rounds is the largest width.

Edge cases: repeated cells count once; null places are left out; places never filled, also beyond the frame, are outside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measura.session import drop_materialized, materialize


def widths(cells: DataFrame, frame: list[str], axes: list[str]) -> DataFrame:
    """(frame, axes, width) of every cell."""
    spark, key = cells.sparkSession, [*frame, *axes]
    alive, out, layer = materialize(cells.select(*key).dropna().distinct(), "erosion"), None, 0
    while not alive.isEmpty():
        layer += 1
        moves = [F.struct(*((F.col(a) + (d if a == axis else 0)).alias(a) for a in axes)) for axis in axes for d in (-1, 1)]
        asked = alive.select(*frame, F.explode(F.array(*moves)).alias("m")).select(*frame, "m.*")
        inner = asked.groupBy(*key).agg(F.count("*").alias("beside")).where(F.col("beside") == 2 * len(axes)).drop("beside")
        kept = materialize(alive.join(inner, key, "left_semi"), "erosion")
        gone = materialize(alive.join(kept, key, "left_anti").withColumn("width", F.lit(layer).cast("long")), "erosion-layer")
        out = gone if out is None else out.unionByName(gone)
        drop_materialized(spark, alive)
        alive = kept
    return out if out is not None else alive.withColumn("width", F.lit(None).cast("long"))
