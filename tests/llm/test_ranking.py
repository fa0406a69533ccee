"""Pairwise ranking against its definition, and its query on held-out rows and odd tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from measura.llm import catalog, ranking


def test_gradient_of_the_pair_loss():
    rng = np.random.default_rng(2)
    d, w = rng.normal(size=(40, 6)), rng.normal(size=6)
    loss, slope = ranking.pair_loss(w, d, 0.01)
    assert loss == pytest.approx(np.mean([np.log(1 + np.exp(-row @ w)) for row in d]) + 0.005 * sum(x * x for x in w))
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert slope[k] == pytest.approx((ranking.pair_loss(w + step, d, 0.01)[0] - ranking.pair_loss(w - step, d, 0.01)[0]) / 2e-6, abs=1e-6)


def test_preferences_are_uniform_over_pairs_of_different_labels():
    labels = np.array([0, 0, 1, 2])
    better, worse = ranking.preferences(labels, 50_000, np.random.default_rng(1))
    assert (labels[better] > labels[worse]).all()
    _, counts = np.unique(better * 4 + worse, return_counts=True)
    assert len(counts) == 5 and counts.min() > 9_500  # (2,0) (2,1) (3,0) (3,1) (3,2)


def test_weights_recover_an_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    truth = x @ np.array([2.0, -1.0, 0.5, 0, 0])
    w = ranking.bradley_terry(x, np.digitize(truth, [-1, 0, 1]), 600, 256, 0.1, 1e-4, 5)
    assert np.corrcoef(x @ w, truth)[0, 1] > 0.98


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "Some words. AND!! more words more words\n" * 300
    at, values = ranking.Features(64).of(text)
    monkeypatch.setattr(ranking, "PIECE", 20_000)
    assert ranking.Features(64).of(text)[0].tolist() == at.tolist()
    assert [p for p in ranking.pieces("ab cd " * 9000)] and "".join(ranking.pieces(text)) == text
    assert np.isfinite(values).all() and ranking.shape("Thenn...é9") == "Aa+.+a0"


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    df = catalog.QUERIES["op11_quality"](spark, sf)
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = {r["doc_id"]: r for r in df.collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    bad, good = [p for p, y in held if y == 0], [p for p, y in held if y == 1]
    assert len(bad) >= 10 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.97 * len(good)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())


def write(folder, docs, labels):
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "score": "x"} for i, t in docs], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("score", pa.string())])), f"{folder}/documents.parquet")
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "quality": q, "toxic": 0} for i, q in labels], pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), f"{folder}/labels.parquet")
    return str(folder)


ODD = [(1, None), (2, ""), (3, " \n"), (None, "No id."), (4, "Same text."), (4, "Same text."), (5, "LOUD!! WORDS!!"), (6, "word " * 300_000), (7, "x" * 1_500_000), (8, "Plain words follow here."), (9, "MORE!! NOISE!!"), (10, "\U0001f600 é")]


@pytest.mark.parametrize("labels", [[], [(5, 0)], [(8, 1), (9, None), (None, 0)], [(4, 1), (8, 1), (5, 0), (9, 0), (9, 1), (1, 0), (2, 1), (10, 1), (99, 0)]])
def test_odd_tables(spark, tmp_path, labels):
    rows = catalog.QUERIES["op11_quality"](spark, write(tmp_path, ODD, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    if len(labels) < 4:
        assert len({r["score"] for r in rows}) == 1


def test_empty_tables(spark, tmp_path):
    assert catalog.QUERIES["op11_quality"](spark, write(tmp_path, [], [])).count() == 0
