"""Column functions against plain arithmetic."""

from __future__ import annotations

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from measura.functions import exact, text
from measura.operators.lanes import with_lanes

PAIRS = [(6, 4), (-6, 4), (6, -4), (0, 5), (1 << 40, 3 << 20), (7, 7)]


def test_ratios(spark):
    df = spark.createDataFrame([(*a, *b) for a in PAIRS for b in PAIRS], "a long, b long, c long, d long")
    x, y = exact.ratio(F.col("a"), F.col("b")), exact.ratio(F.col("c"), F.col("d"))
    rows = df.select("*", exact.ratio_compare(x, y).alias("cmp"), exact.reduced(F.col("a"), F.col("b")).alias("low"), exact.gcd(F.col("a"), F.col("c")).alias("g")).collect()
    for r in rows:
        p, q = Fraction(r["a"], r["b"]), Fraction(r["c"], r["d"])
        assert r["cmp"] == (p > q) - (p < q)
        assert (int(r["low"]["num"]), int(r["low"]["den"])) == (p.numerator, p.denominator)
        assert r["g"] == math.gcd(r["a"], r["c"])
    small = df.where("abs(a) < 100 AND abs(c) < 100 AND abs(b) < 100 AND abs(d) < 100")
    for r in small.select("*", exact.ratio_sum(x, y).alias("s")).collect():
        assert Fraction(int(r["s"]["num"]), int(r["s"]["den"])) == Fraction(r["a"], r["b"]) + Fraction(r["c"], r["d"])
    with pytest.raises(Exception, match="zero denominator"):
        spark.range(1).select(exact.ratio(F.lit(1), F.lit(0))).collect()


def test_codes(spark):
    rows = spark.range(-40, 40).select("id", exact.zigzag(F.col("id")).alias("z"), exact.wrapped(F.col("id"), 4).alias("w"), exact.band(F.col("id")).alias("b")).collect()
    assert sorted(r["z"] for r in rows) == list(range(80))
    assert all(r["w"] == (r["id"] + 8) % 16 - 8 for r in rows)
    assert all(abs(r["b"]) == sum(x <= abs(r["id"]) for x in exact.ladder_rungs(60)) for r in rows)


def test_lower_median(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([4, 1, 2, 3],), ([],)], "v array<int>")
    assert [r[0] for r in df.select(exact.lower_median(F.col("v"))).collect()] == [2, 2, None]


def test_marks(spark):
    df = spark.createDataFrame([("é ñ A",), (None,), ("e\u0301",)], "t string")
    rows = df.select(text.strip_marks("t"), text.marks("t")).collect()
    assert [tuple(r) for r in rows] == [("e n A", 2), (None, 0), ("e", 1)]


def test_clusters(spark):
    df = spark.createDataFrame([("कि ax",), ("क्ष",)], "t string")
    assert [r[0] for r in df.select(text.clusters(F.col("t"))).collect()] == [["कि", " ", "a", "x"], ["क्ष"]]


def test_lanes(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    assert all(r["k"] == r["lane"] for r in with_lanes(df, ["k"]).collect())
    assert with_lanes(df.limit(0), ["k"]).count() == 0


def test_macros_divide_whole_operands():
    from measura.plans.shared import OTHER_FORM, SPARK_FORM, spelled

    assert spelled("DIV(n + 1, 2)", OTHER_FORM) == "((n + 1) // (2))"
    assert spelled("XOR(a, DIV(a + b, c - d))", SPARK_FORM) == "((a) ^ (((a + b) div (c - d))))"


def test_medians_by_brute_force(spark):
    import statistics

    from measura.plans import catalog
    from measura.sources import views

    sf = "/root/testdata/sf0.001"
    users = {}
    for r in views.steps(spark, sf).collect():
        users.setdefault(r["user_id"], {})[r["pos"]] = r["v"]
    want = {(u, p): statistics.median_low([of[k] for k in range(p - 2, p + 3) if k in of]) for u, of in users.items() for p in of}
    assert {(r["user_id"], r["pos"]): r["median"] for r in catalog.QUERIES["window_median"](spark, sf).collect()} == want
