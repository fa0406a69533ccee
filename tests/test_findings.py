"""Queries on tables that a review found them wrong, slow or failing on."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from hashlib import md5
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import TABLES, differences
from pyspark.sql import functions as F

from measura.operators import cloud, in_row, membership, sequences, sift
from measura.plans import catalog, forms
from measura.session import drop_all_materialized

SF = Path("/root/testdata/sf0.001")


@pytest.fixture
def replaced(spark, tmp_path):
    """A folder of the small tables, some of them replaced."""

    def make(**tables: pd.DataFrame) -> str:
        for t in TABLES:
            target = tmp_path / f"{t}.parquet"
            if t in tables:
                tables[t].to_parquet(target)
            else:
                target.symlink_to(SF / target.name)
        return str(tmp_path)

    yield make
    drop_all_materialized(spark)


def check(spark, sf_dir: str, *names: str) -> None:
    for name in names:
        assert differences(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name]) == "", name


def test_a_dense_cloud_begins_with_small_buckets(spark):
    points = spark.range(4096).select("id", (F.col("id") % 16).alias("x"), F.expr("id div 16 % 16").alias("y"), F.expr("id div 256").alias("z"))
    assert cloud.first_side(points, ["x", "y", "z"], 64) == 1
    rows = cloud.nearest(points, ["x", "y", "z"]).collect()
    assert len(rows) == 4096 and {r["distance"] for r in rows} == {1}


def test_a_sparse_cloud_keeps_its_side(spark):
    assert cloud.first_side(spark.range(100).select((F.col("id") * 1000).alias("x")), ["x"], 64) == 64
    assert cloud.first_side(spark.range(0).select(F.col("id").alias("x")), ["x"], 64) == 64


def items(quantity: float) -> pd.DataFrame:
    return pd.read_parquet(SF / "lineitem.parquet").assign(l_quantity=quantity)


def test_noise_moments_beyond_64_bits(spark, replaced):
    sf_dir = replaced(lineitem=items(10_000_000.0))
    g = items(10_000_000.0)
    lanes = g.assign(t=pd.to_datetime(g["l_shipdate"]).dt.year, y=g["l_partkey"] % 16, x=g["l_suppkey"] % 16).groupby(["t", "y", "x"])["l_quantity"].sum()
    want: dict[tuple[int, int], int] = {}
    for (t, y, _), lane in lanes.items():
        want[t, y // 4] = want.get((t, y // 4), 0) + int(lane) ** 3
    assert max(want.values()) >= 1 << 63
    got = {(r["t"], r["block"]): int(r["s3"]) for r in catalog.QUERIES["noise_moments"](spark, sf_dir).collect()}
    assert got == {(t, b): want.get((t, b), 0) for t in lanes.index.levels[0] for b in range(4)}


def test_noise_moments_of_small_lanes_are_64_bit_numbers(spark, replaced):
    df = catalog.QUERIES["noise_moments"](spark, replaced())
    assert {k for _, k in df.dtypes} == {"bigint"}


def test_gloss_tags_beside_letters_beyond_ascii(spark, replaced):
    texts = ["ÉQ DEÊ RELÉ ART!!", "a ÉSG ÊPL\nSG_ _PL SG PL", "SG PL ‘a\rb c’", "", None]
    docs = pd.read_parquet(SF / "documents.parquet").head(len(texts)).assign(text=texts)
    check(spark, replaced(documents=docs), "gloss_lines")


def test_windows_of_events_just_before_their_end(spark, replaced):
    events = pd.read_parquet(SF / "events.parquet").head(6)
    start = datetime.datetime(2024, 1, 1, 6)
    offsets = [-0.6, -0.5, -0.4, 0.4, 0.5, 21599.7]
    events["ts"] = pd.Series([start + datetime.timedelta(seconds=s) for s in offsets], index=events.index).astype("datetime64[us]")
    check(spark, replaced(events=events), "stream_tumbling", "stream_sliding")


def test_constants_of_sizes_of_any_length(spark, replaced):
    part = pd.read_parquet(SF / "part.parquet").head(6).assign(p_size=pd.array([7, 0, -3, 9_999_999, 12_345_678, None], "Int32"))
    sf_dir = replaced(part=part)
    check(spark, sf_dir, "constants")
    assert catalog.QUERIES["constants"](spark, sf_dir).rdd.getNumPartitions() >= 8


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["block_entropy", "line_surprise", "split_half_distance"])
def test_texts_are_counted_inside_their_rows(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, str(SF)))
    assert "MapInArrow" in plan and "Generate explode" not in plan and "posexplode" not in plan


def test_blocks_of_texts_are_counted_inside_their_rows(spark):
    assert "posexplode" not in plan_of(catalog.QUERIES["block_increments"](spark, str(SF)))


def test_texts_of_repeated_and_missing_ids(spark):
    docs = [(1, "abab"), (1, "bac"), (2, "aé𝄞a"), (3, ""), (3, None), (None, "xyx"), (4, "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    by_id: dict = {}
    for k, t in docs:
        by_id.setdefault(k, []).append(t or "")
    cut = lambda t, w: [t[i : i + w] for i in range(len(t) - w + 1)]
    full = {k: ts for k, ts in by_id.items() if any(ts)}
    kinds = {k: tuple(len({b for t in ts for b in cut(t, w)}) for w in (1, 2, 3)) for k, ts in full.items()}
    assert {r["doc_id"]: (r["k1"], r["k2"], r["k3"]) for r in in_row.block_kinds(df, "doc_id", "text").collect()} == kinds
    bits = {}
    for k, ts in full.items():
        n = Counter(b for t in ts for b in cut(t, 2))
        if n:
            bits[k] = -sum(v / n.total() * math.log2(v / n.total()) for v in n.values())
    got = {r["doc_id"]: r["bits"] for r in in_row.pair_entropy(df, "doc_id", "text").collect()}
    assert got.keys() == bits.keys() and all(abs(got[k] - bits[k]) < 1e-9 for k in bits)
    far = {}
    for k, ts in full.items():
        if k is not None:
            half = max(map(len, ts)) // 2
            a, b = Counter(c for t in ts for c in t[:half]), Counter(c for t in ts for c in t[half:])
            far[k] = (sum(abs(a[c] * b.total() - b[c] * a.total()) for c in {*a, *b}), 2 * a.total() * b.total())
    assert {r["doc_id"]: (r["numerator"], r["denominator"]) for r in in_row.half_distance(df, "doc_id", "text").collect()} == far


def test_words_are_hashed_once(spark):
    words = spark.createDataFrame([("a",)] * 3 + [("b",)], "word string")
    plan = membership.build(words, "word", 3, 1 << 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Generate") < plan.rindex("Aggregate")


def test_sequences_share_a_task_batch(spark):
    rows = spark.createDataFrame([(k, i, float((k * i * i) % 7)) for k in range(1, 40) for i in range(k)], "part long, pos long, v double")
    df = sequences.power_exponent(rows, "part", "pos", "v")
    assert "FlatMapGroupsInPandas" not in plan_of(df)
    for r in df.collect():
        v = np.array([float((r["part"] * i * i) % 7) for i in range(r["part"])])
        power = np.abs(np.fft.rfft(v - v.mean()))[1:] ** 2
        parts = [(k + 0.5, power[(1 << k) - 1 : (1 << k + 1) - 1]) for k in range(6)]
        at = [(x, math.log2(p.mean())) for x, p in parts if len(p) and p.mean() > 0]
        assert (r["exponent"] is None) == (len(at) < 2)
        assert len(at) < 2 or abs(r["exponent"] - np.polyfit(*zip(*at, strict=True), 1)[0]) < 1e-6


def test_places_are_told_by_two_runs(spark):
    docs = spark.createDataFrame([(1, "abc......def"), (2, "abc......xyz"), (3, "ab"), (4, None)], "doc_id long, text string")
    anchors = spark.createDataFrame([("abc......def",)], "needle string").select("needle", F.lit(0).cast("long").alias("off"), sift.run_code(F.lit("abc")).alias("run"), sift.run_code(F.lit("def")).alias("later"))
    assert [r["doc"] for r in sift.places(docs, anchors, 12, gap=9).collect()] == [1]
    assert sorted(r["doc"] for r in sift.places(docs, anchors.drop("later"), 12).collect()) == [1, 2]


def test_few_texts_are_python_objects_at_once():
    class Column(list):
        def slice(self, a: int, n: int):
            self.most = max(getattr(self, "most", 0), n)
            return pa.array(self[a : a + n], pa.string())

    column = Column(["x", None] * 500)
    assert list(sift.texts_of(column)) == column and column.most <= 64


def test_documents_meet_each_language_once(spark, replaced):
    docs = pd.read_parquet(SF / "documents.parquet").head(40).reset_index(drop=True)
    docs.loc[1, "doc_id"] = docs.loc[0, "doc_id"]  # two texts of one id
    docs.loc[5, "text"] = None
    docs.loc[1, "lang"] = docs.loc[0, "lang"]
    sf_dir = replaced(documents=docs)
    check(spark, sf_dir, "nearest_centroid_lang")
    assert "BroadcastHashJoin [doc_id" not in plan_of(catalog.QUERIES["nearest_centroid_lang"](spark, sf_dir))
    assert "SortMergeJoin [doc_id" not in plan_of(catalog.QUERIES["nearest_centroid_lang"](spark, sf_dir))


def test_no_documents(spark, replaced):
    docs = pd.read_parquet(SF / "documents.parquet").head(3).assign(text=pd.Series([None, "", ""], dtype="str"))
    check(spark, replaced(documents=docs), "nearest_centroid_lang", "block_increments", "block_entropy", "split_half_distance", "line_surprise", "survivors_by_intersection", "bloom_membership")


def test_hands_of_odd_keys(spark, replaced):
    orders = pd.read_parquet(SF / "orders.parquet").head(400)
    keys = [*range(100), *(k for k in range(1000, 1060) for _ in range(1 + k % 6)), -1, -(10**12), 2**63 - 1, -(2**63), None, None]
    orders = orders.head(len(keys)).assign(o_orderkey=pd.array(keys, dtype="Int64"))
    sf_dir = replaced(orders=orders)
    check(spark, sf_dir, "hand_ranks")
    assert "hashpartitioning(o_orderkey" in plan_of(catalog.QUERIES["hand_ranks"](spark, sf_dir))  # one row group, all cores


def test_hands_of_no_orders(spark, replaced):
    check(spark, replaced(orders=pd.read_parquet(SF / "orders.parquet").head(0)), "hand_ranks")


@pytest.mark.parametrize("kept", [58, 9, 1])
def test_digests_that_begin_alike_are_compared_whole(kept):
    keys = np.array([0, 9, 10, -7, 123456789, 2**63 - 1, -(2**63)], np.int64)
    assert forms.dealt(keys, kept).tolist() == [sorted(range(52), key=lambda c: md5(f"{k}:{c}".encode()).hexdigest())[:5] for k in keys.tolist()]
