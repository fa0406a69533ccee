"""Component trees of lattices of any size, by contraction: joins and grouping, no task that holds a frame.

Cells are swept from the highest value down (ties: the first place first).  A cell that touches no set begins one and is its
top; where sets meet, the one with the highest top goes on and the others end as its children.  The tree's nodes are the
tops; a node ends at the cell where its set meets a higher one, and its size is the number of cells it held before.

1. Each cell gets its rank in the sweep as a code (higher: earlier), by a sort dealt over all tasks.
2. Every cell points to its highest neighbour; pointers are doubled until each cell knows the top that it climbs to.
3. Rounds of contraction.  Of the edges between basins, the strongest of each basin (the highest place where it touches
   another) is where its set first meets another.  If that other one's top is higher, the basin ends there and hooks to it.
   Hooks go upward only, so they make a forest; its roots' labels are spread by doubling, and the edges between what is
   left are merged.  The number of basins falls by a factor in each round.
4. Who holds a place at a moment of the sweep is found by binary lifting over the hooks: the first one that hasn't ended.

Every table is written once a round, so a lost executor costs a re-read; nothing but yes or no reaches the driver.

Edge cases: cells with a null value or place are left out; a place that has several cells keeps its largest value; neighbours
are cells one step away on one axis, so gaps part sets; a lattice of several parts has a root in each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from measura.operators.lanes import with_lanes
from measura.session import drop_materialized, materialize

LEVELS = 40  # of dyadic blocks: nodes of a frame are fewer than 2^LEVELS


def sweep_codes(cells: DataFrame, axes: list[str], value: str, frame: list[str]) -> DataFrame:
    """(frame, axes, value, code): the cells with their rank from the last of the sweep to the first."""
    known = cells.groupBy(*frame, *axes).agg(F.max(value).alias(value)).dropna()
    back = {f"__{a}": -F.col(a) for a in axes}
    return with_lanes(known.select("*", *(c.alias(n) for n, c in back.items())), [value, *frame, *back], "code").drop(*back)


def neighbours(cells: DataFrame, axes: list[str], frame: list[str]) -> DataFrame:
    """cells with ``up`` (the highest code among the cell and its neighbours) and ``next`` (codes of those one step on)."""
    beside, after = [], []
    for a in axes:
        line = W.partitionBy(*frame, *(b for b in axes if b != a)).orderBy(a)
        at = lambda f, step: F.when(f(a, 1).over(line) == F.col(a) + step, f("code", 1).over(line))  # noqa: B023, E731
        cells = cells.withColumns({f"__l_{a}": at(F.lag, -1), f"__n_{a}": at(F.lead, 1)})
        beside += [f"__l_{a}", f"__n_{a}"]
        after.append(f"__n_{a}")
    return cells.withColumn("up", F.greatest("code", *beside)).withColumn("next", F.array_compact(F.array(*after))).drop(*beside)


def doubled(pointers: DataFrame, name: str) -> DataFrame:
    """(node, to) of a forest with every pointer moved to its root; nodes that point nowhere need no row."""
    spark = pointers.sparkSession
    known = materialize(pointers, name)
    while True:
        further = known.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        moved = known.join(further, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), (F.col("beyond") != F.col("to")).alias("moved"))
        following = materialize(moved, name)
        done = following.where("moved").isEmpty()
        drop_materialized(spark, known)
        known = following.drop("moved")
        if done:
            return known


def contract(edges: DataFrame) -> DataFrame:
    """(node, into, death): every basin that ends, the set it ends in and the code of the cell where.

    edges: (a, b, s), basins named by their tops' codes and the highest cell at which they touch.
    """
    spark = edges.sparkSession
    live, ends = materialize(edges, "tree-edges"), None
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
        best = both.groupBy("a").agg(F.max(F.struct("s", "b")).alias("m"))
        hooks = materialize(best.where("m.b > a").select(F.col("a").alias("node"), F.col("m.b").alias("into"), F.col("m.s").alias("death")), "tree-hooks")
        ends = hooks if ends is None else ends.unionByName(hooks)
        if hooks.isEmpty():
            drop_materialized(spark, live)
            return ends
        label = doubled(hooks.select("node", F.col("into").alias("to")), "tree-labels")
        named = lambda df, side: df.join(label.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to")), side, "left").withColumn(side, F.coalesce(f"{side}_to", side)).drop(f"{side}_to")  # noqa: B023, E731
        left = named(named(live, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s"))
        following = materialize(left, "tree-edges")
        drop_materialized(spark, live, label)
        live = following


@dataclass
class Lifting:
    """Jumps of 1, 2, 4, ... hooks, each with the earliest end among the nodes it passes."""

    levels: list[DataFrame]

    @classmethod
    def over(cls, ends: DataFrame) -> Lifting:
        levels = [materialize(ends.select("node", F.col("into").alias("to"), F.col("death").alias("low")), "tree-lift")]
        while True:
            last = levels[-1]
            further = last.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("low").alias("then"))
            next_ = materialize(last.join(further, "to").select("node", F.col("beyond").alias("to"), F.least("low", "then").alias("low")), "tree-lift")
            if next_.isEmpty():
                return cls(levels)
            levels.append(next_)

    def alive(self, asked: DataFrame) -> DataFrame:
        """asked (at, moment, ...) with ``at`` moved to the first node, from it on, that ends after the moment: a jump is
        made where all that it passes have ended."""
        for level in reversed(self.levels):
            jump = level.select(F.col("node").alias("at"), "to", "low")
            asked = asked.join(jump, "at", "left").withColumn("at", F.when(F.col("low") >= F.col("moment"), F.col("to")).otherwise(F.col("at"))).drop("to", "low")
        return asked


def subtree_sums(nodes: DataFrame, value: str) -> DataFrame:
    """(node, total): ``value`` added up over each node and all below it, from (node, parent, value).

    After k rounds a node holds the sum down to 2^k levels below; those exactly 2^k below it add theirs.
    """
    spark = nodes.sparkSession
    sums = materialize(nodes.select("node", F.coalesce(value, F.lit(0)).cast("long").alias("total")), "tree-sums")
    reach = materialize(nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("above")), "tree-reach")
    while not reach.isEmpty():
        below = reach.join(sums, "node").groupBy("above").agg(F.sum("total").alias("more")).withColumnRenamed("above", "node")
        more = materialize(sums.join(below, "node", "left").select("node", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "tree-sums")
        further = materialize(reach.join(reach.select(F.col("node").alias("above"), F.col("above").alias("beyond")), "above").select("node", F.col("beyond").alias("above")), "tree-reach")
        drop_materialized(spark, sums, reach)
        sums, reach = more, further
    return sums


def preorder(nodes: DataFrame) -> DataFrame:
    """(node, first, last): the node's number in a walk of its tree from the root, 0, that visits a node before those below
    it, children from the highest; the nodes below it have the numbers up to ``last``.

    A child's number is its parent's, one, and the sizes of the children before it; these steps are added up along the path
    to the root by doubling.
    """
    spark = nodes.sparkSession
    size = subtree_sums(nodes.withColumn("one", F.lit(1)), "one")
    siblings = W.partitionBy("parent").orderBy(F.desc("node")).rowsBetween(W.unboundedPreceding, -1)
    step = F.when(F.col("parent").isNull(), 0).otherwise(1 + F.coalesce(F.sum("total").over(siblings), F.lit(0))).cast("long")
    walk = materialize(nodes.select("node", "parent").join(size, "node").select("node", "total", F.col("parent").alias("above"), step.alias("first")), "tree-walk")
    while not walk.where("above IS NOT NULL").isEmpty():
        further = walk.select(F.col("node").alias("above"), F.col("above").alias("beyond"), F.col("first").alias("more"))
        following = materialize(walk.join(further, "above", "left").select("node", "total", F.col("beyond").alias("above"), (F.col("first") + F.coalesce("more", F.lit(0))).alias("first")), "tree-walk")
        drop_materialized(spark, walk)
        walk = following
    return walk.select("node", "first", (F.col("first") + F.col("total") - 1).alias("last"))


def tree(cells: DataFrame, axes: list[str], value: str, frame: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, owners) of the upper level sets of a lattice, or of each frame of several.

    nodes: (node, parent, level, cells) and the top's frame and axes; parent is null and level the least value for a root.
    owners: (frame, axes, value, code, node), the node that each cell joins in the sweep.  Nodes are named by their top's
    code.
    """
    spark, frame = cells.sparkSession, frame or []
    coded = materialize(neighbours(sweep_codes(cells, axes, value, frame), axes, frame), "tree-cells")
    basin = doubled(coded.where("up > code").select(F.col("code").alias("node"), F.col("up").alias("to")), "tree-basins")
    top = lambda side: basin.select(F.col("node").alias(side), F.col("to").alias(f"{side}_top"))
    steps = coded.select(F.col("code").alias("p"), F.explode("next").alias("q")).join(top("p"), "p", "left").join(top("q"), "q", "left")
    between = steps.select(F.coalesce("p_top", "p").alias("x"), F.coalesce("q_top", "q").alias("y"), F.least("p", "q").alias("s")).where("x <> y")
    ends = materialize(contract(between.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("s").alias("s"))), "tree-ends")
    lifting = Lifting.over(ends)
    parents = materialize(lifting.alive(ends.select("node", F.col("into").alias("at"), F.col("death").alias("moment"))).select("node", F.col("at").alias("parent"), F.col("moment").alias("death")), "tree-parents")
    held = coded.select("code", *frame, *axes, value).join(basin.withColumnRenamed("node", "code"), "code", "left").withColumn("at", F.coalesce("to", "code")).withColumn("moment", F.col("code")).drop("to")
    owners = materialize(lifting.alive(held).select(*frame, *axes, value, "code", F.col("at").alias("node")), "tree-owners")
    tops = coded.where("up = code").select(F.col("code").alias("node"), *frame, *axes)
    own = owners.groupBy("node").agg(F.count("*").alias("own"))
    nodes = tops.join(parents, "node", "left").join(own, "node", "left")
    sized = nodes.join(subtree_sums(materialize(nodes.select("node", "parent", "own"), "tree-own"), "own"), "node")
    at = coded.select(F.col("code").alias("death"), F.col(value).alias("level"))
    lowest = owners.groupBy(*frame, "node").agg(F.min(value).alias("least")) if frame else owners.groupBy("node").agg(F.min(value).alias("least"))
    out = sized.join(at, "death", "left").join(lowest.select("node", "least"), "node", "left")
    drop_materialized(spark, *lifting.levels)
    nodes = out.select("node", "parent", *frame, *axes, F.coalesce("level", "least").alias("level"), F.col("total").alias("cells"))
    return materialize(nodes, "tree-nodes"), owners


def pairs(owners: DataFrame, axes: list[str], frame: str, lag: int = 1, shift: list[int] | None = None) -> DataFrame:
    """(frame, earlier, later, cells): how many places two nodes of frames ``lag`` apart hold alike, a place of the earlier
    frame being met, moved by ``shift``, in the later one."""
    shift = shift or [0] * len(axes)
    before = owners.select((F.col(frame) + lag).alias("__then"), F.col(frame).alias("frame"), *((F.col(a) + d).alias(a) for a, d in zip(axes, shift, strict=True)), F.col("node").alias("earlier"))
    after = owners.select(F.col(frame).alias("__then"), *axes, F.col("node").alias("later"))
    return before.join(after, ["__then", *axes]).groupBy("frame", "earlier", "later").agg(F.count("*").alias("cells"))


def covering(first: Column, last: Column, levels: int) -> Column:
    """The dyadic blocks, as level and number, that a range of numbers falls into; at most two of each level."""
    start = F.struct(first.alias("lo"), (last + 1).alias("hi"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))
    block = lambda k, b: F.struct(k.cast("int").alias("level"), b.cast("long").alias("block"))

    def step(s: Column, k: Column) -> Column:
        odd_lo, odd_hi = (s["lo"] < s["hi"]) & (s["lo"] % 2 == 1), (s["lo"] < s["hi"]) & (s["hi"] % 2 == 1)
        found = F.array_compact(F.array(F.when(odd_lo, block(k, s["lo"])), F.when(odd_hi & ((s["hi"] - 1 > s["lo"]) | ~odd_lo), block(k, s["hi"] - 1))))
        lo, hi = F.when(odd_lo, s["lo"] + 1).otherwise(s["lo"]), F.when(odd_hi, s["hi"] - 1).otherwise(s["hi"])
        return F.struct(F.floor(lo / 2).alias("lo"), F.floor(hi / 2).alias("hi"), F.concat(s["out"], found).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["out"])


def overlap_sums(met: DataFrame, asked: DataFrame, walk: DataFrame) -> DataFrame:
    """asked (frame, earlier, later) with ``cells``: what pairs() counted, over all nodes at or below the two.

    A subtree is a range of preorder numbers, two of them a rectangle.  Pairs are added up in the dyadic rectangles they lie in,
    each range is covered by few dyadic blocks, and the two meet by equality: no range join, and no row for every
    ancestor.
    """
    most = walk.agg(F.coalesce(F.max("last"), F.lit(0)).alias("n")).first()["n"]
    levels = min(LEVELS, max(1, int(most).bit_length()))
    of = lambda side: walk.select(F.col("node").alias(side), F.col("first").alias(f"{side}_first"), F.col("last").alias(f"{side}_last"))
    placed = met.join(of("earlier"), "earlier").join(of("later"), "later")
    every = F.sequence(F.lit(0), F.lit(levels))
    spread = placed.select("frame", "cells", "later_first", F.explode(F.transform(every, lambda k: F.struct(k.alias("level"), F.col("earlier_first").alias("first")))).alias("e"))
    # One side is added up before the other is spread.
    block = lambda c, k: F.expr(f"CAST(FLOOR({c} / POW(2, {k})) AS BIGINT)")
    one = spread.groupBy("frame", F.col("e.level").alias("el"), block("e.first", "e.level").alias("eb"), "later_first").agg(F.sum("cells").alias("cells"))
    two = one.withColumn("ll", F.explode(every)).groupBy("frame", "el", "eb", "ll", block("later_first", "ll").alias("lb")).agg(F.sum("cells").alias("cells"))
    wanted = asked.join(of("earlier"), "earlier").join(of("later"), "later")
    wanted = wanted.select("frame", "earlier", "later", F.explode(covering(F.col("earlier_first"), F.col("earlier_last"), levels)).alias("e"), "later_first", "later_last")
    wanted = wanted.select("frame", "earlier", "later", F.col("e.level").alias("el"), F.col("e.block").alias("eb"), F.explode(covering(F.col("later_first"), F.col("later_last"), levels)).alias("l"))
    wanted = wanted.select("frame", "earlier", "later", "el", "eb", F.col("l.level").alias("ll"), F.col("l.block").alias("lb"))
    sums = wanted.join(two, ["frame", "el", "eb", "ll", "lb"]).groupBy("frame", "earlier", "later").agg(F.sum("cells").alias("cells"))
    return asked.join(sums, ["frame", "earlier", "later"], "left").select("frame", "earlier", "later", F.coalesce("cells", F.lit(0)).alias("cells"))
