"""Pattern search, nearest points, erosion and streams on crafted rows, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from measura.operators import census, cloud, erosion, sift

AXES = ["x", "y", "z"]


def brute_nearest(points):
    out = {}
    for i, p in points:
        found = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for j, q in points if j != i)
        if found:
            out[i] = found[0][::-1]
    return out


def frame(spark, points):
    return spark.createDataFrame([(i, *p) for i, p in points], "id long, x long, y long, z long")


@pytest.mark.parametrize("side", [1, 64])
def test_nearest_points(spark, side):
    rng = np.random.default_rng(side)
    dense = [(int(i), tuple(int(v) for v in rng.integers(0, 9, 3))) for i in range(60)]
    far = [(100 + int(i), tuple(int(v) for v in rng.integers(-5000, 5000, 3))) for i in range(25)]
    points = [*dense, *far, (500, (7, 7, 7)), (501, (7, 7, 7)), (502, (7, 7, 7))]
    got = {r["id"]: (r["nearest"], r["distance"]) for r in cloud.nearest(frame(spark, points), AXES, side=side).collect()}
    assert got == brute_nearest(points)


def test_nearest_of_few_and_odd_points(spark):
    assert cloud.nearest(frame(spark, [(1, (0, 0, 0))]), AXES).count() == 0
    assert cloud.nearest(frame(spark, []), AXES).count() == 0
    both = [(r["id"], r["nearest"], r["distance"]) for r in cloud.nearest(frame(spark, [(1, (0, 0, 0)), (2, (0, 0, 0)), (None, (1, 1, 1)), (3, (None, 0, 0))]), AXES).collect()]
    assert sorted(both) == [(1, 2, 0), (2, 1, 0)]


def test_shuffled_axes_keep_their_values(spark):
    points = [(i, (i, i * i, -i)) for i in range(30)]
    rows = cloud.shuffled(frame(spark, points), AXES).collect()
    for k, a in enumerate(AXES):
        assert sorted(r[a] for r in rows) == sorted(p[k] for _, p in points)
    assert {r["id"]: r["x"] for r in rows} == {i: p[0] for i, p in points} and any(r["y"] != r["x"] ** 2 for r in rows)


def test_erosion_widths(spark):
    cells = {(0, y, x) for y in range(7) for x in range(9)} - {(0, 3, 3)} | {(1, 5, 5), (1, 6, 5)}
    df = spark.createDataFrame([*cells, (0, 0, 0), (None, 1, 1), (2, None, 1)], "t long, y long, x long")
    got = {(r["t"], r["y"], r["x"]): r["width"] for r in erosion.widths(df, ["t"], ["y", "x"]).collect()}

    def width(t, y, x):
        return min(abs(dy) + abs(dx) for dy in range(-9, 10) for dx in range(-10, 11) if (t, y + dy, x + dx) not in cells)

    assert got == {c: width(*c) for c in cells}
    assert erosion.widths(df.limit(0), ["t"], ["y", "x"]).count() == 0


TEXTS = [(1, "abcabcabdabc"), (2, None), (3, ""), (4, "ab"), (5, "é中😀é中😀x" * 3), (6, "x" * 50 + "abc"), (6, "abc")]


def test_places_of_runs(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    needles = [("abcabd", 0), ("cabd", 1), ("中😀é", 0), ("zzzz", 1)]
    rows = spark.createDataFrame([(n, o, n[o : o + 3]) for n, o in needles], "needle string, off long, sym string").withColumn("run", sift.run_code(F.col("sym"))).drop("sym")
    got = sorted((r["needle"], r["doc"], r["spot"], r["win"], r["length"]) for r in sift.places(docs, rows, 6).collect())
    want = sorted((n, d, i - o, t[i - o : i - o + 6], len(t)) for n, o in needles for d, t in TEXTS if t for i in range(len(t) - 2) if t[i : i + 3] == n[o : o + 3] and i >= o)
    assert got == want
    assert sift.places(docs.limit(0), rows, 6).count() == sift.places(docs, rows.limit(0), 6).count() == 0


def test_runs_that_only_the_bit_array_lets_through_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(sift, "LEAST_BITS", 8)
    monkeypatch.setattr(sift, "PER_RUN", 1)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = spark.createDataFrame([("abc", 0)], "needle string, off long").withColumn("run", sift.run_code(F.col("needle")))
    assert sift.places(docs, rows, 3).count() == sum(t[i : i + 3] == "abc" for _, t in TEXTS if t for i in range(len(t)))


def test_run_counts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    want = {}
    for _, t in TEXTS:
        for i in range(len(t or "") - 2):
            code = sum(ord(c) << s for c, s in zip(t[i : i + 3], (42, 21, 0), strict=True))
            want[code] = want.get(code, 0) + 1
    assert {r["run"]: r["n"] for r in sift.run_counts(docs).collect()} == want


def test_descent_keeps_every_occurrence(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("ab") for _ in range(400))) for i in range(20)]
    needles = ["abbab", "aaaaa", "babab"]
    anchors = spark.createDataFrame([(n, 0) for n in needles], "needle string, off long").withColumn("run", sift.run_code(F.substring("needle", 1, 3)))
    found = sift.places(spark.createDataFrame(docs, "doc_id long, text string"), anchors, 5)
    alive, plan = sift.descend(found, "needle", "needle", 5, 2, 3)
    got = sorted((r["needle"], r["doc"], r["spot"]) for r in alive.where("win = needle").collect())
    assert got == sorted((n, d, i) for n in needles for d, t in docs for i in range(len(t)) if t[i : i + 5] == n)
    start = found.groupBy("needle").count().collect()
    levels = {(r["needle"], r["level"]): r["standing"] for p in plan for r in p.collect()}
    assert all(levels[r["needle"], 1] <= r["count"] and levels[r["needle"], 2] <= levels[r["needle"], 1] for r in start)
    offs = {}
    for p in plan:
        for r in p.collect():
            offs.setdefault(r["needle"], set()).add(r["off"])
    assert all(len(o) == 2 for o in offs.values())


def test_symbols_counted_in_the_row(spark):
    got = sorted((r["doc_id"], r["sym"], r["n"], r["first_pos"]) for r in census.row_census(spark.createDataFrame(TEXTS, "doc_id long, text string"), "doc_id", "text").collect())
    assert got == sorted((d, c, t.count(c), t.index(c)) for d, t in TEXTS if t for c in set(t))
