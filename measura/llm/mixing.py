"""Mixing sources to target weights by hierarchical budgeting.  Native: DataFrame functions only.

Documents are leaves of a tree of domains, languages and sources.  A budget of tokens goes down the tree: a node deals
its budget to its children in proportion to their weights, and no child gets more than its capacity, which is the
tokens below it times ``max_epochs``.  What a child can't take goes to its siblings, again by weight; only what a whole
family can't take is left to the family's own siblings, one level up.  So shortages are made good as near as possible.

A leaf with budget b and s tokens takes b div s whole epochs and, of one more, the documents at the front of an order
seeded by the epoch whose tokens add up to at most b mod s.

A text's tokens are its UTF-8 bytes by 4, rounded up: an estimate that needs no tokenizer.  All figures are whole numbers: shares are rounded down, so a family may get up to one token a child less than its budget.
The last epoch's front is found by hash digits: the tokens below each value of the first digits show in which value
the front ends, those of the next digits narrow it, and only the documents that share both are ordered.

Edge cases: null levels are a node of their own (written as an empty name); null and empty texts hold no tokens and are
taken with every whole epoch and wherever the front has not ended; a leaf without tokens takes none; repeated rows
are separate rows, taken alike but for the row at which the front ends; nodes without a stated weight weigh 1; a
weight of 0 gets nothing; an empty table gives an empty result.  Input columns named like an output column are
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from measura.session import materialize

LEAF_PARTS = 8  # files of the tables with a row for each leaf
DIGITS = 3  # hexadecimal digits looked at in each of the two steps
NEW = ("leaf_budget", "uses")


def path(levels: list[str], depth: int) -> list[Column]:
    return [F.col(c) for c in levels[:depth]]


def deal(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (parent columns, weight, capacity, parent_budget) with budget.

    Children are filled in the order of capacity by weight.  One is full if, at the level of water that would fill it,
    the rest of the budget still covers all children after it; the others share what is left by weight.
    """
    line = W.partitionBy(*parent).orderBy(F.col("capacity").cast("decimal(38,0)") / F.greatest(F.col("weight"), F.lit(1)), "name")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    onward = F.sum("weight").over(W.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    big = lambda c: c.cast("decimal(38,0)")
    walked = (
        children.withColumn("filled", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("onward", onward)
        .withColumn("full", (F.col("weight") > 0) & (big(F.col("capacity")) * F.col("onward") <= big(F.greatest(F.lit(0), F.col("parent_budget") - F.col("filled"))) * F.col("weight")))
    )
    family = W.partitionBy(*parent)
    left = F.greatest(F.lit(0), F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0)))
    weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(family), F.lit(0))
    share = F.when(weight > 0, F.floor(big(left) * F.col("weight") / F.greatest(weight, F.lit(1)))).otherwise(0)
    out = walked.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), share.cast("long"))))
    return out.drop("filled", "onward", "full")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """(levels, supply, budget) from (levels, supply); budget: a Column over the whole supply, ``total``."""
    nodes = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    upper = nodes.groupBy().agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("total"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity")).select(F.least(budget, F.col("capacity")).cast("long").alias("parent_budget"))
    for depth in range(1, len(levels) + 1):
        parent, name = levels[: depth - 1], levels[depth - 1]
        table = weights[depth - 1] if depth <= len(weights) else {}
        weight = F.lit(1).cast("long")
        for key, value in sorted(table.items()):
            weight = F.when(F.col(name) == key, F.lit(value).cast("long")).otherwise(weight)
        children = nodes.groupBy(*levels[:depth]).agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply")).withColumn("name", F.col(name)).withColumn("weight", weight)
        joined = children.join(upper, parent) if parent else children.join(F.broadcast(upper))
        dealt = deal(joined, parent)
        upper = dealt.select(*levels[:depth], F.col("budget").alias("parent_budget"))
    return dealt.select(*levels, "supply", "budget")


def ends(rows: DataFrame, leaf: list[str], digit: str, front: str) -> DataFrame:
    """For each leaf the digit value in which the front ends, and the tokens before that value."""
    sums = rows.groupBy(*leaf, digit).agg(F.sum("tokens").alias("n"), F.max(front).alias(front))
    upto = F.sum("n").over(W.partitionBy(*leaf).orderBy(digit).rowsBetween(W.unboundedPreceding, W.currentRow))
    return sums.withColumn("upto", upto).where(F.col("upto") > F.col(front)).groupBy(*leaf).agg(F.min(F.struct(digit, (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select(*leaf, F.col(f"e.{digit}").alias(f"{digit}_end"), F.col("e.before").alias(f"{digit}_before"))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], budget: Column, max_epochs: int = 2, key: str = "doc_id", text: str = "text", seed: int = 17, keep: list[str] | None = None
) -> DataFrame:
    """docs with leaf_budget (tokens of the leaf) and uses (how often the row is taken), of rows taken at all.

    levels: names and expressions over docs, from the root down.  weights: for each level, weights by node name.
    budget: a Column over ``total``, the tokens of all documents.  keep: the columns of docs to return (None: all).
    """
    names = [f"level{i}" for i in range(len(levels))]
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in NEW])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    tokens = F.expr(f"(octet_length(coalesce(`{text}`, '')) + 3) div 4").cast("long")
    placed = docs.select(
        row.alias("row"), *(F.coalesce(e.cast("string"), F.lit("")).alias(n) for n, e in zip(names, levels.values(), strict=True)), tokens.alias("tokens"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("text:"), F.md5(body))).alias("key"),
    )
    leaves = placed.groupBy(*names).agg(F.sum("tokens").alias("supply"))
    budgets = materialize(leaf_budgets(leaves, names, weights, budget, max_epochs).coalesce(LEAF_PARTS), "mix-budgets")
    drawn = placed.join(budgets, names).withColumn("epochs", F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0)).withColumn("front", F.when(F.col("supply") > 0, F.col("budget") % F.col("supply")).otherwise(0))
    drawn = drawn.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("epochs").cast("string"), "key")))
    drawn = drawn.withColumn("d1", F.substring("h", 1, DIGITS)).withColumn("d2", F.substring("h", DIGITS + 1, DIGITS))
    first = materialize(ends(drawn, names, "d1", "front").coalesce(LEAF_PARTS), "mix-first")
    split = drawn.join(first, names, "left")
    inner = split.where("d1 = d1_end").withColumn("front", F.col("front") - F.col("d1_before"))
    second = materialize(ends(inner, names, "d2", "front").coalesce(LEAF_PARTS), "mix-second")
    split = split.join(second, names, "left")
    edge = F.coalesce((F.col("d1") == F.col("d1_end")) & (F.col("d2") == F.col("d2_end")), F.lit(False))
    upto = F.sum("tokens").over(W.partitionBy(*names).orderBy("h", "key", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow))
    at_edge = split.where(edge).withColumn("taken", F.col("d1_before") + F.col("d2_before") + upto <= F.col("front"))
    inside = (F.col("d1") < F.col("d1_end")) | ((F.col("d1") == F.col("d1_end")) & (F.col("d2") < F.col("d2_end")))
    away = split.where(~edge).withColumn("taken", F.coalesce(inside, F.lit(False)))
    both = away.unionByName(at_edge).withColumn("uses", (F.col("epochs") + F.when(F.col("taken"), 1).otherwise(0)).cast("long"))
    return both.where("uses > 0").select("row.*", *(F.col(n).alias(name) for n, name in zip(names, levels, strict=True) if name not in (docs.columns if keep is None else keep)), F.col("budget").alias("leaf_budget"), "uses")
