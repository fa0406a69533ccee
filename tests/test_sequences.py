"""Sequence operators against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from measura.operators import sequences


def test_hilbert_index_walks_one_cell_at_a_time(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    rows = sorted((r["place"], r["x"], r["y"]) for r in cells.select("x", "y", sequences.hilbert_index(F.col("x"), F.col("y"), 4).alias("place")).collect())
    assert [r[0] for r in rows] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("every", [1, 7, 30])
def test_match_rate(spark, every):
    text = "abcabcabd" * 40 + "".join(np.random.default_rng(3).choice(list("ab"), 300))
    df = spark.createDataFrame([(1, text), (2, None), (3, "ab")], "doc_id long, text string")
    got = {r["doc_id"]: (r["places"], r["matched"]) for r in sequences.match_rate(df, "doc_id", "text", 50, every).collect()}
    places = range(50, len(text), every)
    want = sum(next((n for n in range(1, len(text) - at + 1) if text[at : at + n] not in text[at - 50 : at]), len(text) - at + 1) for at in places)
    assert got == {1: (len(places), want), 2: (0, 0), 3: (0, 0)}


def test_stays(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 6, 7, 9, 9, 5])], "k long, pos long, v long")
    assert [tuple(r) for r in sequences.stays(rows, "k", "pos", "v", 2).collect()] == [(1, 3, 6)]


@pytest.mark.parametrize("seed", range(4))
def test_component_tree_has_one_leaf_for_every_maximum(seed):
    plane = np.random.default_rng(seed).permutation(36).reshape(6, 6)
    tree = sequences.component_tree(plane)
    padded = np.pad(plane, 1, constant_values=-1)
    peaks = {y * 6 + x for y in range(6) for x in range(6) if plane[y, x] > max(padded[y, x + 1], padded[y + 2, x + 1], padded[y + 1, x], padded[y + 1, x + 2])}
    assert {t[0] for t in tree} == peaks
    assert tree[-1][1] == -1 and tree[-1][3] == 36


def test_average_linkage():
    d = np.array([[0, 1, 9], [1, 0, 7], [9, 7, 0]], float)
    assert sequences.average_linkage(["a", "b", "c"], d) == [("a", "b", 1.0), ("(a b)", "c", 8.0)]
