"""Plans against brute force on tables in which nothing may be left out."""

from __future__ import annotations

import datetime
from itertools import product
from math import prod

from measura.plans import catalog


def lineitem(spark, folder, keys):
    rows = [(i, part, supplier, 1, 5.0 + i, datetime.datetime(1995 + i % 2, 3, 1)) for i, (part, supplier) in enumerate(keys)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp")
    df.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


KINDS = ("click", "error", "purchase", "scroll", "signup", "view", "another kind")


def events(spark, folder, cells):
    """A table whose occupied cells are these (day of January, kind, user)."""
    rows = [(i, datetime.datetime(2024, 1, day, 9), user, KINDS[z], 1.0, "{}") for i, (day, z, user) in enumerate(cells)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def interleaved(x, y):
    return sum(((x >> k & 1) << 2 * k) + ((y >> k & 1) << 2 * k + 1) for k in range(31))


def test_morton_order_of_large_keys(spark, tmp_path):
    keys = [(0, 0), (3, 5), (255, 9), (256, 9), (1_999, 99), (1_999, 99), (70_000, 65_537), (2**31 - 1, 2**31 - 1)]
    got = {(r["x"], r["y"]): (r["n"], r["z"]) for r in catalog.QUERIES["morton_order"](spark, lineitem(spark, tmp_path, keys)).collect()}
    assert got == {k: (keys.count(k), interleaved(*k)) for k in keys}


def test_marginal_sums_of_all_kinds_and_users(spark, tmp_path):
    days = {1: {0: [1, 5], 3: [5, 9, 15], 6: [1, 15]}, 2: {k: [k, 8 + k] for k in range(7)}, 3: {4: [7]}}
    cells = [(day, z, y) for day, kinds in days.items() for z, ys in kinds.items() for y in ys]
    got = catalog.QUERIES["marginal_sums"](spark, events(spark, tmp_path, cells + cells[:3])).collect()
    want = {}
    for day, kinds in days.items():
        weights = []
        for picked in product(*([None, *ys] for ys in kinds.values())):
            targets = [p for p in picked if p is not None]
            if len(set(targets)) == len(targets):
                weights.append(prod(len(ys) for p, ys in zip(picked, kinds.values(), strict=True) if p is not None))
        want[day] = (len(weights), sum(weights))
    assert {(datetime.date(1970, 1, 1) + datetime.timedelta(r["day"])).day: (r["arrangements"], r["total"]) for r in got} == want


def test_frame_chains_that_begin_later(spark, tmp_path):
    held = {(0, 2): [1, 2, 5, 6, 7], (4, 9): [3], (5, 15): [2, 3, 4, 8], (6, 0): [1, 3, 5]}
    cells = [(day, z, y) for (z, y), days in held.items() for day in days]
    got = catalog.QUERIES["frame_chains"](spark, events(spark, tmp_path, cells + cells[:2])).collect()
    assert sorted((r["z"], r["y"], r["len"]) for r in got) == [(0, 2, 3), (4, 9, 1), (5, 15, 3), (6, 0, 1)]


def test_symmetry_sites_of_the_whole_lattice(spark, tmp_path):
    keys = [(0, 0), (3, 3), (4, 1), (1, 4), (15, 15), (16 + 9, 32 + 12)]
    got = catalog.QUERIES["symmetry_sites"](spark, lineitem(spark, tmp_path, keys)).collect()
    want = []
    for y, x in {(part % 16, supplier % 16) for part, supplier in keys}:
        want += [(op, y, x, sx % 16, sy % 16) for op, (sx, sy) in enumerate([(x, y), (-y, x), (-x, -y), (y, -x)])]
    assert sorted((r["op"], r["y"], r["x"], r["sx"], r["sy"]) for r in got) == sorted(want)


def test_part_graphs_take_small_orders(spark, tmp_path):
    keys = [(part, supplier) for part in range(1, 5) for supplier in range(1, 5)] + [(5, 1), (6, 9), (6, 9)]
    folder = lineitem(spark, tmp_path, keys)
    roots = {r["node"]: r["root"] for r in catalog.QUERIES["part_components"](spark, folder).collect()}
    assert roots == {2 * p: 2 for p in range(1, 6)} | {2 * s + 1: 2 for s in range(1, 5)} | {12: 12, 19: 12}
    core = {r["node"]: r["degree"] for r in catalog.QUERIES["k_core"](spark, folder).collect()}
    assert core == {2 * p: 4 for p in range(1, 5)} | {2 * s + 1: 4 for s in range(1, 5)}


def test_box_sums_of_every_kind(spark, tmp_path):
    cells = [(day, z, y) for day, z, y in product((1, 2), range(7), range(16)) if (day * 5 + z * 3 + y * y) % 7 < 2]
    got = catalog.QUERIES["box_sums"](spark, events(spark, tmp_path, cells + cells[:3])).collect()
    want = []
    for day, z in sorted({(d, k) for d, k, _ in cells}):
        own = [y for d, k, y in cells if (d, k) == (day, z)]
        held = [y for d, k, y in cells if d == day and abs(k - z) <= 1 and min(own) <= y <= max(own)]
        want.append((day, z, len(held), sum(held)))
    assert sorted(((datetime.date(1970, 1, 1) + datetime.timedelta(r["day"])).day, r["z"], r["cells"], r["total"]) for r in got) == want
