"""Component trees by contraction, pairs of nodes between frames and sums over subtrees (survey 2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.operators import merge_tree
from measura.session import materialize
from measura.sources import views

SIDE = 16


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, y, x, lane): the lattice with its empty cells as 0."""
    g = views.grid(spark, sf_dir)
    places = spark.range(SIDE * SIDE).select(F.expr(f"id div {SIDE}").alias("y"), (F.col("id") % SIDE).alias("x"))
    return g.select("t").distinct().crossJoin(F.broadcast(places)).join(g, ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("lane", F.lit(0)).alias("lane"))


def merge_tree_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all years as one volume."""
    nodes, _ = merge_tree.tree(full(spark, sf_dir), ["t", "y", "x"], "lane")
    above = nodes.select(F.col("node").alias("parent"), *(F.col(c).alias(f"parent_{c}") for c in "tyx"))
    return nodes.join(above, "parent", "left").select("t", "y", "x", "parent_t", "parent_y", "parent_x", "level", "cells")


def merge_tree_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of each year's frame, in the columns of component_tree."""
    nodes, _ = merge_tree.tree(full(spark, sf_dir), ["y", "x"], "lane", ["t"])
    place = (F.col("y") * SIDE + F.col("x")).alias("place")
    above = nodes.select(F.col("node").alias("parent"), place)
    return nodes.select("t", "node", "parent", "level", "cells", place.alias("own")).join(above, "parent", "left").select("t", F.col("own").alias("node"), F.coalesce("place", F.lit(-1)).alias("parent"), "level", "cells")


def framed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, names of nodes, pairs of nodes of neighbouring frames)."""
    nodes, owners = merge_tree.tree(full(spark, sf_dir), ["y", "x"], "lane", ["t"])
    names = nodes.select("node", (F.col("y") * SIDE + F.col("x")).alias("place"))
    return nodes, names, materialize(merge_tree.pairs(owners, ["y", "x"], "t"), "tree-pairs")


def named(df: DataFrame, names: DataFrame) -> DataFrame:
    for side in ("earlier", "later"):
        df = df.join(names.select(F.col("node").alias(side), F.col("place").alias(f"{side}_place")), side)
    return df.select(F.col("frame").alias("t"), F.col("earlier_place").alias("earlier"), F.col("later_place").alias("later"), "cells")


def tree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names, met = framed(spark, sf_dir)
    return named(met, names)


def tree_overlap_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every pair of nodes that hold a place alike: the places that their subtrees hold alike."""
    nodes, names, met = framed(spark, sf_dir)
    return named(merge_tree.overlap_sums(met, met.select("frame", "earlier", "later"), merge_tree.preorder(nodes.select("node", "parent"))), names)


def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preorder numbers of the nodes of each year's tree."""
    nodes, names, _ = framed(spark, sf_dir)
    walk = merge_tree.preorder(nodes.select("node", "parent"))
    return walk.join(nodes.select("node", "t"), "node").join(names, "node").select("t", F.col("place").alias("node"), "first", "last")


def sweep(volume: bool) -> str:
    """SQL that sweeps the cells one at a time, with the set of every cell in a list: ``own`` has the top that each cell joins,
    ``nodes`` every top with the one it ends in, the step where it ends and its size; tops are named by their step."""
    frame, place = ("CAST(0 AS BIGINT)", f"(dense_rank() OVER (ORDER BY t) - 1) * {SIDE * SIDE} + y * {SIDE} + x") if volume else ("t", f"y * {SIDE} + x")
    beside = [(f"c % {SIDE} > 0", -1), (f"c % {SIDE} < {SIDE - 1}", 1), (f"(c // {SIDE}) % {SIDE} > 0", -SIDE), (f"(c // {SIDE}) % {SIDE} < {SIDE - 1}", SIDE)]
    if volume:
        beside += [(f"c >= {SIDE * SIDE}", -SIDE * SIDE), (f"c < len(cs) - {SIDE * SIDE}", SIDE * SIDE)]
    near = ", ".join(f"CASE WHEN {when} THEN labels[c + 1 + {by}] END" for when, by in beside)
    return f"""
    WITH RECURSIVE g AS ({views.SQL["g"]}), years AS (SELECT DISTINCT t FROM g),
         whole AS (SELECT years.t, a.range AS y, b.range AS x, coalesce(g.lane, 0) AS lane FROM years CROSS JOIN range({SIDE}) a CROSS JOIN range({SIDE}) b LEFT JOIN g ON g.t = years.t AND g.y = a.range AND g.x = b.range),
         cells AS MATERIALIZED (SELECT f, t, y, x, c, lane, row_number() OVER (PARTITION BY f ORDER BY lane DESC, c) AS step FROM (SELECT {frame} AS f, t, y, x, lane, {place} AS c FROM whole)),
         swept AS MATERIALIZED (SELECT f, list(c ORDER BY step) AS cs FROM cells GROUP BY f),
         run(f, step, labels, winner, died) AS (
           SELECT f, CAST(0 AS BIGINT), list_transform(cs, lambda v: CAST(NULL AS BIGINT)), CAST(NULL AS BIGINT), CAST([] AS STRUCT(top BIGINT, size BIGINT)[]) FROM swept
           UNION ALL
           SELECT f, step, list_transform(labels, lambda l, i: CASE WHEN i = c + 1 OR list_contains(n, l) THEN best ELSE l END), best,
                  list_transform(list_filter(n, lambda l: l <> best), lambda l: struct_pack(top := l, size := CAST(len(list_filter(labels, lambda v: v = l)) AS BIGINT)))
           FROM (SELECT f, step, labels, c, n, coalesce(list_min(n), step) AS best
                 FROM (SELECT f, step, labels, c, list_distinct(list_filter([{near}], lambda l: l IS NOT NULL)) AS n
                       FROM (SELECT r.f, r.step + 1 AS step, r.labels, s.cs[r.step + 1] AS c, s.cs FROM run r JOIN swept s USING (f) WHERE r.step < len(s.cs))))),
         own AS MATERIALIZED (SELECT f, step, winner FROM run WHERE step > 0),
         died AS (SELECT f, step, winner, unnest(died) AS d FROM run),
         ended AS (SELECT f, d.top AS top, winner AS parent, step AS ends, d.size AS size FROM died),
         nodes AS MATERIALIZED (
           SELECT f, top, parent, ends, size FROM ended
           UNION ALL SELECT f, step, NULL, NULL, NULL FROM own WHERE step = winner AND NOT EXISTS (SELECT 1 FROM ended e WHERE e.f = own.f AND e.top = own.step))"""


TREE = """
    SELECT {columns}, CAST(coalesce(l.lane, (SELECT MIN(lane) FROM cells z WHERE z.f = n.f)) AS BIGINT) AS level, CAST(coalesce(n.size, (SELECT COUNT(*) FROM cells z WHERE z.f = n.f)) AS BIGINT) AS cells
    FROM nodes n JOIN cells c ON c.f = n.f AND c.step = n.top LEFT JOIN cells p ON p.f = n.f AND p.step = n.parent LEFT JOIN cells l ON l.f = n.f AND l.step = n.ends"""
FRAMES = sweep(False) + TREE.format(columns="n.f AS t, c.c AS node, coalesce(p.c, -1) AS parent")
PAIRS = """,
         held AS MATERIALIZED (SELECT o.f, k.c, w.c AS top FROM own o JOIN cells k ON k.f = o.f AND k.step = o.step JOIN cells w ON w.f = o.f AND w.step = o.winner),
         met AS MATERIALIZED (SELECT a.f AS t, a.top AS earlier, b.top AS later, COUNT(*) AS cells FROM held a JOIN held b ON b.f = a.f + 1 AND b.c = a.c GROUP BY ALL)"""
ABOVE = """,
         tops AS MATERIALIZED (SELECT n.f, c.c AS node, p.c AS parent, n.top FROM nodes n JOIN cells c ON c.f = n.f AND c.step = n.top LEFT JOIN cells p ON p.f = n.f AND p.step = n.parent),
         above(f, node, up) AS (SELECT f, node, node FROM tops UNION ALL SELECT a.f, a.node, t.parent FROM above a JOIN tops t ON t.f = a.f AND t.node = a.up WHERE t.parent IS NOT NULL)"""

REGISTRY = {
    "merge_tree_volume": (merge_tree_volume, sweep(True) + TREE.format(columns="c.t AS t, c.y AS y, c.x AS x, p.t AS parent_t, p.y AS parent_y, p.x AS parent_x")),
    "merge_tree_frames": (merge_tree_frames, FRAMES),
    "tree_pairs": (tree_pairs, sweep(False) + PAIRS + " SELECT t, earlier, later, cells FROM met"),
    "tree_overlap_sums": (
        tree_overlap_sums,
        sweep(False) + PAIRS + ABOVE + """
    SELECT m.t, m.earlier, m.later, CAST(SUM(o.cells) AS BIGINT) AS cells FROM met m JOIN above a ON a.f = m.t AND a.up = m.earlier JOIN above b ON b.f = m.t + 1 AND b.up = m.later
    JOIN met o ON o.t = m.t AND o.earlier = a.node AND o.later = b.node GROUP BY m.t, m.earlier, m.later""",
    ),
    "tree_walk": (
        tree_walk,
        sweep(False) + ABOVE + """,
         below AS (SELECT f, up AS node, COUNT(*) AS n FROM above GROUP BY f, up),
         -- Paths from the root, as lists of the tops' steps, are in preorder where children go from the highest top, the smallest step.
         paths(f, node, path) AS (SELECT f, node, [top] FROM tops WHERE parent IS NULL UNION ALL SELECT t.f, t.node, list_append(p.path, t.top) FROM paths p JOIN tops t ON t.f = p.f AND t.parent = p.node)
    SELECT p.f AS t, p.node, CAST(row_number() OVER (PARTITION BY p.f ORDER BY path) - 1 AS BIGINT) AS first, CAST(row_number() OVER (PARTITION BY p.f ORDER BY path) - 2 + n AS BIGINT) AS last FROM paths p JOIN below b ON b.f = p.f AND b.node = p.node""",
    ),
}
