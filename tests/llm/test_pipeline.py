"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import re

import duckdb
import pytest

import corpus_pipeline
from measura.llm import catalog, wu_manber
from measura.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return [(d.columns, [r.asDict() for r in d.collect()]) for d in out]


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages_keep_the_columns(stages):
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])
    assert set(stages[0][0]) < set(stages[-1][0])


def test_toxic_documents_go_and_clean_ones_stay(stages):
    left = {r["doc_id"] for r in stages[1][1]}
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1][1], {r["doc_id"] for r in stages[2][1]}
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    assert after == {find(i) for i in sets}


def test_contaminated_documents_go(stages):
    items = [(str(i), t.encode()) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    tables = wu_manber.compile_items(items, 10)
    want = {r["doc_id"] for r in stages[2][1] if not wu_manber.scan(tables, (r["text"] or "").encode())[2]}
    assert {r["doc_id"] for r in stages[3][1]} == want


def test_mix_and_shards(stages):
    before, mixed, sharded = (s[1] for s in stages[3:])
    tokens = lambda rows: sum((len((r["text"] or "").encode()) + 3) // 4 for r in rows)
    assert 0 < tokens(mixed) <= tokens(before) * 9 // 10
    ids = [r["doc_id"] for r in mixed]
    assert max(map(ids.count, ids)) <= corpus_pipeline.MAX_EPOCHS and set(ids) <= {r["doc_id"] for r in before}
    assert sorted(ids) == sorted(r["doc_id"] for r in sharded)
    counts = [sum(r["shard"] == s for r in sharded) for s in range(24)]
    assert max(counts) - min(counts) <= 1


def test_repeated_and_nameless_documents(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (None, "q r s t u v", "en", "s", 1), (None, "q r s t u v", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect())
    assert got == [(False, 1), (False, 2), (False, 3), (True, 0)]


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "h i j k l m n", "en", "s", 1), (2, "a  b c d e f g", "en", "s", 1), (-5, "x y z u v w", "en", "s", 1), (None, "x y z u v w", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect())
    assert got == [(-5, "x y z u v w"), (1, "a b c d e f g"), (1, "h i j k l m n")]


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0


def test_every_operator_has_a_query():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in catalog.QUERIES}
    assert numbers == set(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram join", "decontamination", "mixing", "sharding"]
