"""Secrets, nearest neighbours, mixing, joins and sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from measura.llm import mixing, ngram_join, one_bit_ann, op2_secrets, secrets, sharding

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_spans(spark):
    texts = [
        None, "", "token=token: abcdefghijk", "PassWord = 'hunter2hunter2' x", "é😀 api_key:abcdefgh12 AKIA" + "Z" * 16, "f" * 31 + " " + "0a" * 16 + "g", "AKIAAKIA" * 3,
        "secret==abcdefghij token = short token=longenough1", "x" * 50_000 + " token=abcdefgh9", "token=abcdefgh9", "token=abcdefgh9", "t Zq3" + "aB4" * 9,
    ]
    rows = [(i, t, f"s{i % 4}", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, found string")
    for r in secrets.scan(df).collect():
        got = [(x["start"], x["kind"], x["end"]) for x in r["found"] if x["kind"] < 3]
        assert got == base_spans(r["text"] or "")
    by = {r["doc_id"]: r["found"] for r in secrets.scan(df).collect()}
    assert [x["owners"] for x in by[8]] == [3] and not by[8][0]["live"]
    assert [secrets.KINDS[x["kind"]] for x in by[11]] == ["token"]
    assert secrets.scan(df.limit(0)).count() == 0


def test_secret_digest(spark, sf):
    import duckdb

    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())
    for r in op2_secrets.query(spark, sf).collect():
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("dimension", [3, 64, 70])
def test_nearest_rows(spark, dimension):
    rng = np.random.default_rng(dimension)
    x = rng.normal(size=(400, dimension)).astype(np.float32)
    x[50:150] = x[3]  # a hot vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(0, x[0].tolist(), "x"), (900, None, "x"), (901, [0.0] * dimension, "x"), (902, [float("nan")] * dimension, "x"), (903, [1.0], "x"), (904, [None] * dimension, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in one_bit_ann.nearest(df, F.col("id") % 25 == 0, block=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 400, 25):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert sorted(got[q]) == list(range(1, 11))
        hits += len({got[q][k][0] for k in got[q]} & set(want))
        assert all(abs(d[i] - s) < 1e-9 for i, s in got[q].values())
    assert set(got) == set(range(0, 400, 25)) and hits >= 0.97 * 160


def test_an_id_with_several_vectors_finds_ten_others(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(14, 8)).astype(np.float32).astype(float)
    near = [(x[0] + 0.001 * k).tolist() for k in range(3)]
    rows = [(100, v) for v in near] + [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(200, x[3].tolist()), (300, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in one_bit_ann.nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = {}
    for q, v in rows:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q)[:10]
            want.setdefault(q, []).extend((k + 1, s, i) for k, (s, i) in enumerate(d))
    assert len(got[100]) == 30 and sorted(got) == [100, 200, 300]
    for q in want:
        assert [(k, i) for k, _, i in sorted(got[q])] == [(k, i) for k, _, i in sorted(want[q])]


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token=abcdefgh{i:06d}" if i % 2 else "AKIA" + f"{i:016d}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text, "a"), (2, "", None)], "doc_id long, text string, source string")
    began = time.perf_counter()
    row = next(r for r in secrets.scan(docs, keep=["doc_id"]).select("doc_id", F.size("found").alias("n"), F.try_element_at("found", F.lit(-1)).alias("last")).collect() if r["doc_id"] == 1)
    assert row["n"] == 200_000 and text[row["last"]["start"] : row["last"]["end"]] == "token=abcdefgh199999"
    assert time.perf_counter() - began < 20


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 2.0]), (7, [3.0, 2.0])], "vec_id long, embedding array<float>")
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in one_bit_ann.nearest(df, F.col("id") == 0).collect())
    assert rows == [(0, 1, 5, 0.0), (0, 2, 7, 2.0)]
    assert one_bit_ann.nearest(df.limit(0), F.col("id") == 0).count() == 0


def brute_groups(docs, words, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "num", "small"), [(3, 90, 32), (5, 80, 32), (3, 90, 3), (2, 60, 4)])
def test_ngram_groups_against_brute_force(spark, monkeypatch, words, num, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rng = random.Random(words * num + small)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    passage = [rng.choice(vocabulary) for _ in range(15)]
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 80]))] + passage
        for _ in range(9):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary).upper()
            docs.append((n, " ".join(text)))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE"), (n + 4, "one two"), (n + 5, " \t\x1c ")]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(df, words=words, num=num, den=100).collect()}
    assert got == brute_groups(docs, words, num, 100)


def test_ngram_groups_of_odd_rows(spark, odd_docs):
    rows = ngram_join.groups(odd_docs).collect()
    assert len(rows) == 8
    assert {r["component_id"] for r in rows if r["doc_id"] == 4} == {4}
    assert ngram_join.groups(odd_docs.limit(0)).count() == 0


def test_near_copies_are_compared_once_for_all_their_hot_tokens(spark, monkeypatch):
    """40 texts that share nine tenths of their tokens: their sets come to one block, and tokens are joined to few rows."""
    words = [f"w{i}" for i in range(100)]
    docs = [(k, " ".join([*words[: 2 * k + 10], f"x{k}", *words[2 * k + 11 :]])) for k in range(40)]
    rows, plans = spark.sparkContext.accumulator(0), []
    links, write = ngram_join.block_links, ngram_join.materialize

    def counting(num, den):
        run = links(num, den)

        def counted(group):
            rows.add(len(group))
            return run(group)

        return counted

    def noting(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(ngram_join, "block_links", counting)
    monkeypatch.setattr(ngram_join, "materialize", noting)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(df).collect()}
    assert got == brute_groups(docs, 3, 90, 100)
    assert 0 < rows.value <= len(docs)
    assert sum(plan.count("Join Inner, (token#") for plan in plans) <= 3


def levels():
    return {"domain": F.col("domain"), "source": F.col("source")}


def test_mixing_shortage_goes_to_siblings_first(spark):
    # Each text is one token.  a1 can give 2 at most, so a2 makes that good; b gets its own half.
    rows = [(i, "abcd", "a", "a1") for i in range(1)] + [(10 + i, "abcd", "a", "a2") for i in range(30)] + [(50 + i, "abcd", "b", "b1") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, source string")
    got = mixing.mix(df, levels(), [], F.lit(40), 2).groupBy("source").agg(F.max("leaf_budget").alias("b"), F.sum("uses").alias("n")).collect()
    assert {r["source"]: (r["b"], r["n"]) for r in got} == {"a1": (2, 2), "a2": (18, 18), "b1": (20, 20)}
    # A family that can't take its share leaves it to its own siblings.
    got = mixing.mix(df.where("source <> 'a2'"), levels(), [], F.lit(40), 2).groupBy("source").agg(F.sum("uses").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a1": 2, "b1": 38}


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, None, "s"), (2, "", "d", None), (3, "abcdefgh", "d", "s"), (3, "abcdefgh", "d", "s"), (None, "abcd", "d", "s"), (4, "x" * 80_000, "e", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, source string").withColumn("uses", F.lit("clash"))
    out = mixing.mix(df, levels(), [{"e": 0}], F.expr("total"), 3)
    assert out.where("domain = 'e'").count() == 0
    assert out.groupBy().agg(F.sum(F.expr("uses * ((octet_length(coalesce(text, '')) + 3) div 4)")).alias("n")).first()["n"] <= 20_005
    assert mixing.mix(df.limit(0), levels(), [], F.expr("total"), 3).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 24, 100, 1000])
def test_ring_is_balanced_and_gapless(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("c").alias("slot"))
    rows = sharding.shard_ring(df, shards=24).collect()
    assert len(rows) == n
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_ring_moves_only_rows_of_full_shards(spark):
    """Against a walk row by row: rows stay while their shard has room, the others go on clockwise."""
    shards, vnodes, cells, n, seed = 4, 3, 64, 157, 7
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    points = sorted(tuple(r) for r in sharding.ring_points(spark, shards, vnodes, cells, seed).collect())
    keyed = df.select("doc_id", F.xxhash64(F.lit(seed), F.lit("key"), "doc_id").alias("h")).withColumn("cell", F.pmod(F.shiftright("h", 20), F.lit(cells))).collect()
    ring = sorted(keyed, key=lambda r: (r["cell"], r["h"], r["doc_id"]))
    owner = lambda cell: next((p for p in points if p[0] >= cell), points[0])
    room = {s: n // shards + (s < n % shards) for s in range(shards)}
    home, queue = {}, []
    for r in ring:
        s = owner(r["cell"])[1]
        if room[s]:
            room[s] -= 1
            home[r["doc_id"]] = s
        else:
            queue.append((owner(r["cell"])[0], r["cell"] > owner(r["cell"])[0], r))
    line = []
    for turn in range(2):
        for at, (pos, s, _) in enumerate(points):
            if turn == 0 and (at == 0 or points[at - 1][0] != pos):
                line += [r for p, wraps, r in queue if p == pos and wraps] + [r for p, wraps, r in queue if p == pos and not wraps]
            while line and room[s]:
                room[s] -= 1
                home[line.pop(0)["doc_id"]] = s
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_ring(df, shards=shards, vnodes=vnodes, cells=cells, seed=seed).collect()}
    assert got == home


def test_ring_of_odd_rows(spark, odd_docs):
    rows = sharding.shard_ring(odd_docs, shards=3).collect()
    assert len(rows) == 8 and sorted(r["size"] for r in rows)[:2] == [8, 8]
    assert len({(r["shard"], r["slot"]) for r in rows}) == 8
