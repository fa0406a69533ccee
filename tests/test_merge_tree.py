"""Component trees by contraction against the sweep of one plane, with ties, gaps and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from measura.operators import merge_tree, sequences


def frame(spark, values, t=0):
    return [(t, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(values)]


def found(nodes, width):
    at = {r["node"]: r["y"] * width + r["x"] for r in nodes}
    return sorted((at[r["node"]], at.get(r["parent"], -1), r["level"], r["cells"]) for r in nodes)


@pytest.mark.parametrize(("seed", "most"), [(1, 3), (2, 1000), (3, 1)])
def test_tree_equals_the_sweep(spark, seed, most):
    values = np.random.default_rng(seed).integers(0, most, (9, 11))
    cells = spark.createDataFrame(frame(spark, values), "t long, y long, x long, lane long")
    nodes, owners = merge_tree.tree(cells, ["y", "x"], "lane")
    assert found(nodes.collect(), 11) == sorted(sequences.component_tree(values))
    assert owners.count() == values.size


def test_gaps_nulls_and_repeats(spark):
    rows = [(0, 0, 5), (0, 1, 3), (0, 3, 4), (0, 3, 2), (1, None, 9), (2, 0, None), (5, 5, 1)]
    cells = spark.createDataFrame([(*r, "x") for r in rows], "y long, x long, lane long, code string")
    nodes, _ = merge_tree.tree(cells.drop("code"), ["y", "x"], "lane")
    got = sorted((r["y"], r["x"], r["parent"], r["level"], r["cells"]) for r in nodes.collect())
    assert got == [(0, 0, None, 3, 2), (0, 3, None, 4, 1), (5, 5, None, 1, 1)]
    empty, owners = merge_tree.tree(cells.drop("code").limit(0), ["y", "x"], "lane")
    assert empty.count() == owners.count() == 0


def test_walk_and_sums_of_a_long_chain(spark):
    n = 70
    nodes = spark.createDataFrame([(i, i + 1 if i + 1 < n else None, 1) for i in range(n)] + [(1000, 3, 5)], "node long, parent long, v long")
    sums = {r["node"]: r["total"] for r in merge_tree.subtree_sums(nodes, "v").collect()}
    assert sums[1000] == 5 and [sums[i] for i in range(n)] == [i + 1 + (5 if i >= 3 else 0) for i in range(n)]
    walk = {r["node"]: (r["first"], r["last"]) for r in merge_tree.preorder(nodes).collect()}
    assert walk[n - 1] == (0, n) and walk[1000] == (n - 3, n - 3) and walk[0] == (n, n)


def test_sums_of_rectangles(spark):
    rng = np.random.default_rng(5)
    parents = [None] + [int(rng.integers(0, i)) for i in range(1, 40)]
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(parents)], "node long, parent long")
    met = {(int(a), int(b)): int(c) for a, b, c in rng.integers(0, 40, (120, 3))}
    asked = [(int(a), int(b)) for a, b in rng.integers(0, 40, (60, 2))]

    def chain(i):
        while i is not None:
            yield i
            i = parents[i]

    want = {(a, b): sum(c for (x, y), c in met.items() if a in chain(x) and b in chain(y)) for a, b in asked}
    frames = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = merge_tree.overlap_sums(frames([(0, a, b, c) for (a, b), c in met.items()], "frame long, earlier long, later long, cells long"), frames([(0, a, b) for a, b in set(asked)], "frame long, earlier long, later long"), merge_tree.preorder(nodes))
    assert {(r["earlier"], r["later"]): r["cells"] for r in got.collect()} == want
