"""Exact clustering against a plain version with Python's whole numbers."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from measura.llm import catalog, lloyd


def plain(rows, clusters=40, rounds=5, dimension=64):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(of[k]) for x in zip(*of[k], strict=True)] if k in of else c for k, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = {}
    for _, k, d in found:
        sums[k] = sums.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, sums[k], sum(sums.values()), digest[k]) for i, k, d in found), key=repr)


def run(spark, folder, rows):
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("key", pa.string()), ("cluster", pa.int64())])
    pq.write_table(pa.Table.from_pylist([{"vec_id": i, "embedding": v, "key": "x", "cluster": 1} for i, v in rows], schema), f"{folder}/embeddings.parquet")
    df = catalog.QUERIES["op12_clusters"](spark, str(folder))
    assert dict(df.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(n, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in np.float32(rng.normal(size=64) * scale)] for _ in range(n)]


def test_query_equals_the_plain_version(spark, tmp_path):
    of = vectors(150)
    rows = list(enumerate(of)) + [(500 + k, of[3]) for k in range(150)] + [(900, None), (901, of[0][:63]), (902, [None, *of[0][1:]]), (903, [math.nan, *of[0][1:]]), (904, [math.inf, *of[0][1:]]), (None, of[5]), (905, [0.0] * 64), (906, [-0.0] * 64)]
    rows.append(rows[0])
    assert run(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(7, None)], [(1, [0.5] * 64), (2, [0.5] * 64)], [(None, [1.0] * 64)]])
def test_few_rows(spark, tmp_path, rows):
    if rows and rows[0][0] is None:
        assert [r[2] for r in run(spark, tmp_path, rows)] == [0]
    else:
        assert run(spark, tmp_path, rows) == plain(rows)


def test_wide_values_are_exact(spark, tmp_path):
    rows = [(i, [x * 10 ** (i % 7 * 0.9) for x in v]) for i, v in enumerate(vectors(60, 2, 50.0))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_values_past_64_bits_do_not_fail(spark, tmp_path):
    rows = [*enumerate(vectors(50, 3)), (99, [3e38] * 64), (100, [-3e38] * 64)]
    got = run(spark, tmp_path, rows)
    assert len(got) == 52 and all(0 <= r[2] <= (1 << 63) - 1 for r in got)


def test_digits_add_up():
    rng = random.Random(3)
    for value in [0, 1, -1, 1 << 40, -(1 << 80), *(rng.randrange(-(10**30), 10**30) for _ in range(200))]:
        assert sum(d << lloyd.DIGIT * p for p, d in lloyd.digits(value)) == value
