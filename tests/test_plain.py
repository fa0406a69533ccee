"""Queries that SQL doesn't express, against plain versions over the same tables."""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from compare import connect

from measura.plans import catalog
from measura.sources import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def rows(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def test_match_rate(spark, con):
    def matched(text, window=256):
        total = 0
        for at in range(window, len(text)):
            behind, n = text[at - window : at], 1
            while n <= min(len(text) - at, window) and text[at : at + n] in behind:
                n += 1
            total += n
        return total

    texts = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents WHERE length(text) < 3000").fetchall())
    got = {r["doc_id"]: (r["places"], r["matched"]) for r in rows(spark, "match_rate")}
    assert len(texts) > 100
    for i, t in texts.items():
        places, found = got[i]
        assert places == max(0, len(t) - 256)
        # At the end of a text, a string that reaches it counts one more than the text has.
        assert abs(found - matched(t)) <= 0


def test_power_exponent(spark, con):
    series = defaultdict(list)
    for part, _, v in con.sql(f"SELECT part, pos, v FROM ({views.SQL['q']}) ORDER BY part, pos").fetchall():
        series[part].append(v)
    got = {r["part"]: r["exponent"] for r in rows(spark, "power_exponent")}
    assert set(got) == set(series)
    for part, v in itertools.islice(series.items(), 40):
        n, mean = len(v), sum(v) / len(v)
        power = [abs(sum((x - mean) * complex(math.cos(2 * math.pi * k * i / n), -math.sin(2 * math.pi * k * i / n)) for i, x in enumerate(v))) ** 2 for k in range(1, n // 2 + 1)]
        points = []
        for k in range(6):
            band = power[(1 << k) - 1 : (1 << (k + 1)) - 1]
            if band and sum(band) > 1e-9:
                points.append((k + 0.5, math.log2(sum(band) / len(band))))
        if len(points) < 2:
            assert got[part] is None
            continue
        mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        assert got[part] == pytest.approx(sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points), abs=1e-6)


def test_mark_inventory(spark, con):
    texts = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for r in rows(spark, "mark_inventory"):
        t = texts[r["doc_id"]]
        runs = [len(x) for x in re.findall("[A-Z]+", t)]
        assert r["marks"] == sum(1 for c in unicodedata.normalize("NFD", t) if unicodedata.combining(c))
        assert (r["runs"], r["longest"]) == (len(runs), max(runs, default=None))
        assert r["letters"] == sum(unicodedata.category(c)[0] == "L" for c in t)


def test_heaviest_matching(spark, con):
    """Total weight by trying, along each row of cells, every way to match them in order: partners differ by one at most."""
    cells = defaultdict(set)
    for day, z, y in con.sql(views.SQL["c"]).fetchall():
        cells[day, z].add(y)
    want = Counter()
    for (day, z), ys in cells.items():
        later = cells.get((day + 1, z), set())
        best = {frozenset(): 0}  # taken cells of the later day among the last ones in reach
        for y in sorted(ys):
            grown = {}
            for taken, weight in best.items():
                for to, gain in [(None, 0), *((t, 3 - abs(t - y)) for t in (y - 1, y, y + 1) if t in later and t not in taken)]:
                    key = frozenset(t for t in (taken | {to}) if t is not None and t >= y)
                    grown[key] = max(grown.get(key, -1), weight + gain)
            best = grown
        want[day] += max(best.values())
    got = {r["day"]: r["total"] for r in rows(spark, "heaviest_matching")}
    assert got == {d: t for d, t in want.items() if t}


def test_cluster_tree(spark, con):
    counts = defaultdict(Counter)
    for lang, word in con.sql(f"SELECT lang, word FROM ({views.SQL['w']})").fetchall():
        counts[lang][word] += 1
    share = {g: {w: n / sum(c.values()) for w, n in c.items()} for g, c in counts.items() if g is not None}
    far = lambda a, b: math.sqrt(sum((share[a].get(w, 0) - share[b].get(w, 0)) ** 2 for w in share[a].keys() | share[b].keys()))
    groups, merges = {g: [g] for g in share}, []
    while len(groups) > 1:
        d, a, b = min((sum(far(x, y) for x in groups[a] for y in groups[b]) / len(groups[a]) / len(groups[b]), a, b) for a in groups for b in groups if a < b)
        merges.append((a, b, d))
        groups[f"({a} {b})"] = groups.pop(a) + groups.pop(b)
    got = [(r["a"], r["b"], r["height"]) for r in sorted(rows(spark, "cluster_tree"), key=lambda r: r["step"])]
    assert [g[:2] for g in got] == [m[:2] for m in merges]
    assert [g[2] for g in got] == pytest.approx([m[2] for m in merges])


def test_approximate_profiles(spark, con):
    exact = {f: (n, parts, q) for f, n, parts, q in con.sql("SELECT l_returnflag, COUNT(*), COUNT(DISTINCT l_partkey), quantile_disc(l_quantity, [0.25, 0.5, 0.75]) FROM lineitem GROUP BY 1").fetchall()}
    got = rows(spark, "approximate_profiles")
    assert {r["l_returnflag"] for r in got} == set(exact)
    for r in got:
        n, parts, quartiles = exact[r["l_returnflag"]]
        assert r["n"] == n and r["parts"] == pytest.approx(parts, rel=0.1)
        assert all(abs(a - b) <= 1 for a, b in zip(r["quartiles"], quartiles, strict=True))
