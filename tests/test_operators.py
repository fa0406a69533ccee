"""Operators against brute force on small inputs."""

from __future__ import annotations

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from measura.operators import census, frames, graph, membership
from measura.operators.program import Program, ladder_rungs


def reach(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == reach(edges)


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_k_core(spark):
    square = [(a, b) for a, b in itertools.combinations(range(4), 2)]
    got = {r["node"]: r["degree"] for r in graph.k_core(spark.createDataFrame([*square, (3, 9), (9, 10)], "a long, b long"), 3).collect()}
    assert got == dict.fromkeys(range(4), 3)


@pytest.mark.parametrize("seed", range(8))
def test_heaviest_matching(seed):
    rng = random.Random(seed)
    pairs = {(a, b): rng.randrange(1, 9) for a in range(4) for b in range(4) if rng.random() < 0.6}
    if not pairs:
        return
    best = 0
    for n in range(1, 5):
        for chosen in itertools.combinations(pairs, n):
            if len({a for a, _ in chosen}) == len({b for _, b in chosen}) == n:
                best = max(best, sum(pairs[c] for c in chosen))
    found = frames.best_assignment(pd.DataFrame([(a, b, w) for (a, b), w in pairs.items()], columns=["a", "b", "weight"]))
    assert found["weight"].sum() == best
    assert found["a"].is_unique and found["b"].is_unique


def test_program_steps(spark):
    rows = spark.createDataFrame([(17, -5), (-17, 5), (0, 3), (1 << 40, 1 << 20)], "x long, y long")
    p = Program().field("a", "x").field("b", "y").quotient("q", "a", "b").remainder("r", "a", "b").gcd("g", "a", "b").compare("c", "a", "b").wrap("w", "a", 8).ladder("l", "a", "b")
    for row in p.apply(rows).collect():
        a, b = row["x"], row["y"]
        q = abs(a) // abs(b) * (1 if a * b >= 0 else -1)
        assert (row["q"], row["r"]) == (q, a - q * b)
        assert row["c"] == (a > b) - (a < b)
        assert row["w"] == (a + 128) % 256 - 128
        assert row["l"] == (a > 0) * sum(r * abs(b) <= abs(a) for r in ladder_rungs(60)) - (a < 0) * sum(r * abs(b) <= abs(a) for r in ladder_rungs(60))


def test_overflow_and_zero_divisors_fail(spark):
    rows = spark.createDataFrame([(1 << 62, 0)], "x long, y long")
    with pytest.raises(Exception, match="OVERFLOW"):
        Program().field("a", "x").product("p", "a", "a").apply(rows).collect()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        Program().field("a", "x").field("b", "y").quotient("p", "a", "b").apply(rows).collect()


def test_census_of_nulls_and_empties(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "aab"), (4, "é😀")], "doc_id long, text string")
    got = {(r["doc_id"], r["sym"]): r["n"] for r in census.census(rows, "doc_id", "text").collect()}
    assert got == {(3, "a"): 2, (3, "b"): 1, (4, "é"): 1, (4, "😀"): 1}


def test_entry_lists_queries_and_oracles():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bloom_filter_never_misses(spark):
    held = spark.createDataFrame([(f"wört{i}",) for i in range(200)] + [(None,)], "w string")
    asked = spark.createDataFrame([(f"wört{i}",) for i in range(300)] + [("",)], "w string")
    bits = membership.build(held.where("w IS NOT NULL"), "w", 3, 1 << 14)
    rows = {r["w"]: r["maybe"] for r in membership.contains(asked, "w", bits, 3, 1 << 14).collect()}
    assert all(rows[f"wört{i}"] for i in range(200))
    assert sum(rows.values()) < 215

    def fnv(data, h):
        for b in data:
            h = ((h ^ b) * membership.PRIME) % (1 << 32)
        return h

    got = spark.createDataFrame([("aé",)], "w string").select(membership.fnv1a(F.col("w"), 0)).first()[0]
    assert got == fnv("aé".encode(), membership.START)
