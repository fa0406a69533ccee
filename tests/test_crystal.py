"""Lifting towers, their codes, stored blocks and their proof; periods beside their null."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from measura.functions import coding, tower
from measura.operators import crystal, period, shared_pattern


def lifted_by_definition(v):
    n, high, out = len(v), {}, list(v)
    for i in range(1, n, 2):
        high[i] = v[i] - (v[i - 1] + (v[i + 1] if i + 1 < n else v[i - 1])) // 2
    for i in range(0, n, 2):
        before, after = high.get(i - 1, high.get(i + 1)), high.get(i + 1, high.get(i - 1))
        if before is not None:
            out[i] = v[i] + (before + after + 2) // 4
    return [high.get(i, x) for i, x in enumerate(out)]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 17])
def test_one_step_is_the_definition(n):
    v = np.random.default_rng(n).integers(0, 1000, n)
    assert tower.lift(v, 1).tolist() == lifted_by_definition(v.tolist())


@pytest.mark.parametrize("shape", [(1,), (16,), (7, 9), (5, 1, 33), (3, 40, 24)])
@pytest.mark.parametrize("levels", [1, 2, 3])
def test_lowering_is_the_inverse(shape, levels):
    a = np.random.default_rng(1).integers(0, 1 << 16, shape)
    assert (tower.lower(tower.lift(a, levels), levels) == a).all()


def test_blocks_with_borders_have_the_whole_lattice_s_coefficients():
    a, levels = np.random.default_rng(2).integers(0, 1 << 16, (70, 90)), 2
    whole, extents, blocks = tower.lift(a, levels), (1, 70, 90), (1, 16, 32)
    for place in np.ndindex(1, 5, 3):
        outer, inner = crystal.around(place, extents, blocks, tower.halo(levels))
        part = tower.lift(a[outer[1], outer[2]], levels)
        i, j = place[1] * 16, place[2] * 32
        assert (part[inner[1], inner[2]] == whole[i : i + 16, j : j + 32]).all()


@pytest.mark.parametrize("most", [1, 3, 500, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 64, 65, 777])
def test_codes_round_trip(n, most):
    v = np.random.default_rng(n).integers(0, most, n)
    data, bits, first = coding.pack(v)
    assert (coding.unpack(data, n, first) == v).all() and len(data) == -(-bits // 8)
    z = coding.unzigzag(v)
    assert (coding.zigzag(z) == v).all()


def test_escapes_are_cheaper_than_long_runs():
    v = np.zeros(64, np.int64)
    v[7] = (1 << 32) - 1
    data, bits, first = coding.pack(v)
    assert (coding.unpack(data, 64, first) == v).all() and bits == 5 + 63 + 24 + 32


EXTENTS, BLOCKS, LEVELS = (3, 20, 37), (2, 8, 16), 1


def cells(spark):
    a = np.random.default_rng(3).integers(0, 1 << 16, EXTENTS)
    rows = [(7, t, y, x, int(v)) for (t, y, x), v in np.ndenumerate(a)] + [(8, 0, 0, 0, 5)]
    return spark.createDataFrame(rows, "sample long, t long, y long, x long, lane long")


def test_stored_blocks_give_back_the_lanes_and_prove_them(spark):
    rows = cells(spark)
    stored = crystal.encode(rows, EXTENTS, BLOCKS, LEVELS)
    back = crystal.decode(stored, EXTENTS, BLOCKS, LEVELS).where("lane <> 0 OR sample = 7").select("sample", "t", "y", "x", "lane")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    kept = crystal.roots(stored)
    assert {r["sample"]: r["proved"] for r in crystal.prove(stored, kept, EXTENTS, BLOCKS, LEVELS).collect()} == {7: True, 8: True}
    # One bit of one payload, or one missing block, and the sample isn't proved.
    flipped = stored.withColumn("payload", F.when((F.col("sample") == 7) & (F.col("bx") == 1) & (F.col("by") == 0) & (F.col("bt") == 0), F.unhex(F.concat(F.substring(F.hex("payload"), 1, 40), F.when(F.substring(F.hex("payload"), 41, 1) == "0", "1").otherwise("0"), F.expr("substring(hex(payload), 42)")))).otherwise(F.col("payload")))
    lost = stored.where("NOT (sample = 7 AND by = 2 AND bx = 0 AND bt = 1)")
    for bad in (flipped, lost):
        assert {r["sample"]: r["proved"] for r in crystal.prove(bad, kept, EXTENTS, BLOCKS, LEVELS).collect()} == {7: False, 8: True}


def test_places_outside_the_extents_fail(spark):
    with pytest.raises(Exception, match="outside the extents"):
        crystal.encode(spark.createDataFrame([(1, 0, 99, 0, 1)], "sample long, t long, y long, x long, lane long"), EXTENTS, BLOCKS, LEVELS).collect()


def test_a_planted_period_is_found_and_none_in_its_shuffles(spark):
    rng = np.random.default_rng(6)
    pattern = rng.integers(0, 50, (12, 5))
    values = {0: np.tile(pattern, (1, 8)), 1: rng.integers(0, 4, (12, 40)), 2: rng.permuted(np.tile(pattern, (1, 8)), axis=1)}
    rows = [(t, int(y), int(x), int(v)) for t, a in values.items() for (y, x), v in np.ndenumerate(a)]
    df = spark.createDataFrame(rows, "t long, y long, x long, v long")
    got = {(r["frame"], r["axis"]): r for r in period.periods(df, "t", ["y", "x"], "v", 20, 40).collect()}
    found = got[0, "x"]
    assert found["period"] == 5 and found["beyond"] and found["height"] > 10 * max(found["band"], 1)
    assert not any(got[t, "x"]["beyond"] for t in (1, 2))
    short = period.periods(df.where("x < 3 AND y < 2"), "t", ["y", "x"], "v", 1, 3).collect()
    assert all(r["period"] is None and not r["beyond"] for r in short)


def test_the_root_is_the_term_of_the_least_price_and_comes_back():
    rng = np.random.default_rng(8)
    stripes = np.broadcast_to(rng.integers(0, 1 << 15, (1, 16, 1)), (6, 16, 12)) + rng.integers(0, 4, (6, 16, 12))
    noise = rng.integers(0, 1 << 15, (6, 16, 12))
    for values in (stripes, noise):
        term, bits, saved = shared_pattern.root(values, 2)
        gains = [bits - shared_pattern.price(values - (p := shared_pattern.pattern(values, kept)), 2) - shared_pattern.price(p, 2) for kept in shared_pattern.TERMS]
        assert saved == max(0, *gains) and (term == gains.index(saved) if saved else term == -1)
    assert shared_pattern.TERMS[shared_pattern.root(stripes, 2)[0]] == (1,)


def test_boxes_come_back_from_residual_and_pattern(spark):
    rows = cells(spark)
    found = shared_pattern.roots(rows, EXTENTS, BLOCKS, LEVELS)
    back = shared_pattern.returned(found, EXTENTS, BLOCKS).where("lane <> 0 OR sample = 7")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_ladder_of_shot_noise(spark):
    rng = np.random.default_rng(9)
    level = rng.uniform(20, 400, (12, 15))
    values = rng.poisson(level, (40, 12, 15))
    rows = [(1, t, y, x, int(v)) for (t, y, x), v in np.ndenumerate(values)]
    r = shared_pattern.ladder(spark.createDataFrame(rows, "sample long, t long, y long, x long, lane long"), 40, 10).collect()[0]
    n, scale = 10, 30
    assert r["blocks"] == 4 * 180
    assert int(r["slope2"]) / int(r["denominator"]) / (n * (n - 1)) * scale == pytest.approx(1, abs=0.15)  # variance grows as the level
    blocks = values.reshape(4, 10, 12, 15)
    x = (values.sum(0) - blocks.sum(1)).ravel().astype(float)
    k2 = (blocks.var(1, ddof=1) * n * (n - 1)).ravel()
    assert int(r["slope2"]) / int(r["denominator"]) == pytest.approx(np.polyfit(x, k2, 1)[0])
    assert shared_pattern.ladder(spark.createDataFrame(rows, "sample long, t long, y long, x long, lane long"), 10, 10).count() == 0
