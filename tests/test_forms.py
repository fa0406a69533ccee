"""Wide numbers, codes, cliques, glosses and strict JSON on crafted rows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from measura.functions import coding, text, wide
from measura.operators import graph
from measura.sources import corpora


def test_wide_numbers(spark):
    rng = np.random.default_rng(2)
    number = lambda n: int("".join(map(str, rng.integers(0, 10, n))))
    pairs = [(0, 0), (0, 10**50), (10**300 - 1, 10**299), *((number(int(n)), number(int(m))) for n, m in rng.integers(1, 250, (30, 2)))]
    rows = [(str(a if i % 3 else -a), str(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame([*rows, (None, "1")], "a string, b string")
    out = df.select("a", "b", wide.product(F.col("a"), F.col("b")).alias("p"), wide.sum_of(F.expr("replace(a, '-', '')"), F.col("b")).alias("s"), wide.compare(F.expr("replace(a, '-', '')"), F.col("b")).alias("c"))
    for r in out.collect():
        if r["a"] is None:
            assert r["p"] is None
            continue
        a, b = int(r["a"]), int(r["b"])
        assert (r["p"], r["s"], r["c"]) == (str(a * b), str(abs(a) + b), (abs(a) > b) - (abs(a) < b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 65535), min_size=0, max_size=300))
def test_coding_round_trip(values):
    lanes = np.array(values, np.int64)
    data, bits = coding.encode(lanes) if len(lanes) else (b"", 0)
    assert coding.decode(data, len(lanes)).tolist() == values
    assert len(data) == -(-bits // 8)


def test_max_clique_by_brute_force(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for g in range(12):
        pairs = {(a, b) for a, b in combinations(range(9), 2) if rng.random() < 0.5}
        rows += [(g, a, b) if rng.random() < 0.5 else (g, b, a) for a, b in pairs]
        sets = [c for n in range(2, 10) for c in combinations(range(9), n) if all(p in pairs for p in combinations(c, 2))]
        if sets:
            want[g] = min(sets, key=lambda c: (-len(c), c))
    rows += [(99, 1, 1), (98, None, 2)]
    got = graph.max_clique(spark.createDataFrame(rows, "g long, a long, b long"), "g").collect()
    assert {r["g"]: tuple(r["members"]) for r in got} == want


def test_gloss_lines(spark):
    lines = ["dog-PL see-3SG", "a key: 1SG; 2SG; PL", "x: PL y: SG", "‘I didn't sleep’", "no marks", "'ab'", "", "  she said “go home now” again"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = df.select(text.is_gloss(F.col("line")).alias("g"), text.translation(F.col("line")).alias("t"), text.morphemes(F.col("line")).alias("m")).collect()
    assert [r["g"] for r in rows] == [True, False, False, False, False, False, False, False]
    assert [r["t"] for r in rows] == [None, None, None, "I didn't sleep", None, None, None, "go home now"]
    assert rows[0]["m"] == 4 and rows[6]["m"] == 0


def test_treebank_rows(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# sent_id = s1\n1-2\tDu\tdu\tX\t_\tF\n1\tDe\tde\tADP\t_\tF=1\n1.1\te\te\tX\t_\t_\n2\tLe\tLE\tDET\t_\tG\n\n# sent_id = s2\nbroken\n1\tx\n")
    rows = corpora.treebank(spark, str(tmp_path)).collect()
    assert [(r["sentence"], r["place"], r["form"], r["reading"]) for r in rows] == [("s1", 1, "de", "de|ADP|F=1"), ("s1", 2, "le", "le|DET|G")]


def test_malformed_json_fails(spark):
    df = spark.createDataFrame([('{"a": 1',)], "j string").select(F.from_json("j", "a long", {"mode": "FAILFAST"}).alias("x"))
    with pytest.raises(Exception, match="(?i)malformed"):
        df.collect()
