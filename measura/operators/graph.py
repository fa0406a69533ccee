"""Graphs as edge tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measura.session import drop_materialized, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", parts: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge.

    Alternates two star contractions until nothing changes: every node's larger neighbours, then its smaller ones,
    are tied to the smallest neighbour.  The number of rounds grows with the logarithm of the nodes; nothing but two
    figures of the edge set reaches the driver.  Null ends and loops are left out.  parts: the most files that a round is
    written in, where the caller knows how many the edges need.
    """
    spark = edges.sparkSession
    first, second = F.col(f"`{a}`"), F.col(f"`{b}`")

    def written(df: DataFrame) -> DataFrame:
        return materialize(df.coalesce(parts) if parts else df, "components")

    pairs = written(edges.select(F.least(first, second).alias("lo"), F.greatest(first, second).alias("hi")).where("lo < hi").distinct())
    known = None
    while True:
        figures = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if figures == known or not figures["n"]:
            break
        known = figures
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        smallest = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(smallest, F.col("hi") == F.col("u"))
        out = small.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct()
        following = written(out)
        drop_materialized(spark, pairs)
        pairs = following
    ends = pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return ends.unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def k_core(edges: DataFrame, k: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, degree) of the largest part of the graph in which every node keeps k neighbours or more.

    Peels nodes of smaller degree until none is left to peel; each round is written, so lost executors cost a re-read.
    """
    spark = edges.sparkSession
    first, second = F.col(f"`{a}`"), F.col(f"`{b}`")
    pairs = materialize(edges.select(F.least(first, second).alias("lo"), F.greatest(first, second).alias("hi")).where("lo < hi").distinct(), "core")
    while True:
        ends = pairs.select(F.explode(F.array("lo", "hi")).alias("node"))
        degrees = ends.groupBy("node").agg(F.count("*").alias("degree"))
        weak = materialize(degrees.where(F.col("degree") < k).select("node"), "core-weak")
        if weak.isEmpty():
            return degrees
        kept = pairs.join(weak, F.col("lo") == F.col("node"), "left_anti").join(weak, F.col("hi") == F.col("node"), "left_anti")
        following = materialize(kept, "core")
        drop_materialized(spark, pairs, weak)
        pairs = following


def max_clique(edges: DataFrame, group: str, a: str = "a", b: str = "b") -> DataFrame:
    """(group, size, members): the largest set of nodes of each group's graph that are all joined to one another; of several,
    the first by its sorted members.  Groups without an edge have no row.

    One group is one task's work: branch and bound over neighbour sets, for graphs of up to some hundred nodes.
    """

    def best_of(pairs: set[tuple[int, int]]) -> list[int]:
        nodes = sorted({x for p in pairs for x in p})
        place = {x: i for i, x in enumerate(nodes)}
        near = [0] * len(nodes)
        for x, y in pairs:
            near[place[x]] |= 1 << place[y]
            near[place[y]] |= 1 << place[x]
        best: list[int] = []

        def grow(chosen: list[int], open_: int) -> None:
            nonlocal best
            if len(chosen) > len(best):
                best = chosen
            while open_ and len(chosen) + open_.bit_count() > len(best):
                i = (open_ & -open_).bit_length() - 1  # in order of nodes, so that the first of equal size is kept
                open_ &= open_ - 1
                grow([*chosen, i], open_ & near[i])

        grow([], (1 << len(nodes)) - 1)
        return [nodes[i] for i in best]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        found = best_of({(x, y) for x, y in zip(rows["a"], rows["b"], strict=True) if x != y})
        keys, ok = rows["g"][:1], len(found) > 0
        return pa.table({"g": pa.array(keys if ok else [], pa.int64()), "size": pa.array([len(found)] if ok else [], pa.int64()), "members": pa.array([found] if ok else [], pa.list_(pa.int64()))})

    ends = edges.select(F.col(f"`{group}`").cast("long").alias("g"), F.col(f"`{a}`").cast("long").alias("a"), F.col(f"`{b}`").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return ends.groupBy("g").applyInArrow(run, "g long, size long, members array<bigint>").withColumnRenamed("g", group)
