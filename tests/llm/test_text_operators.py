"""Token counts, token files, decontamination, language and toxicity against libraries and brute force."""

from __future__ import annotations

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from measura.llm import language_id, op1_language_id, op10_toxicity, simple8b, token_counts, token_files, toxicity, wu_manber
from measura.llm.pretoken import pieces
from measura.llm.textops import new_key, span_hashes, unequal

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = st.text(alphabet=st.sampled_from(list("abetrs 'lLvVmd12½²\n\t  éñ中😀<|>.,!-")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=5))
def test_counts_equal_the_library(texts):
    texts = [*texts, "a<|endoftext|>b"]
    got = token_counts.counter(PATH).count(texts)
    assert got.tolist() == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    ids, lengths = token_files.encoder(PATH).encode(texts)
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_pieces_of_chunks_that_cross_texts():
    texts = ["x" * 700, "", " a  b\n\n c" * 90]
    p = pieces(texts)
    assert p.strings(np.arange(len(p.starts))) == [m for t in texts for m in re.findall(r" ?[a-z]+|\s+(?!\S)|\s+", t)]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    assert (simple8b.decode(simple8b.encode(values)) == values).all()


def test_simple8b_blocks_and_widths():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << k, 400, dtype=np.uint64) for k in range(1, 63)] + [np.zeros(500, np.uint64)])
    record = simple8b.encode(values)
    assert (np.concatenate([simple8b.decode_block(record, b) for b in range(-(-len(values) // simple8b.BLOCK))]) == values).all()


def test_span_hashes_depend_on_content_and_key():
    data = np.frombuffer(b"abc-abc-abd", np.uint8)
    spans = np.array([0, 4, 8]), np.array([3, 7, 11])
    key, other = new_key(), new_key()
    h = span_hashes(data, *spans, key)
    assert h[0] == h[1] != h[2]
    assert (h != span_hashes(data, *spans, other)).all()


def test_unequal_spans():
    data = np.frombuffer(b"abc-abc-abd-ab", np.uint8)
    starts, ends = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 14])
    assert unequal(data, starts, ends, np.array([0, 0, 0, 0])).tolist() == [2, 3]
    assert unequal(data, starts, ends, np.arange(4)).tolist() == []


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    import measura.llm.pretoken as pretoken

    monkeypatch.setattr(pretoken, "span_hashes", lambda points, starts, ends, key: (ends - starts).astype(np.uint64))  # all of one length collide
    p = pieces(["one two six two", "ten one"])
    strings, back = p.distinct()
    assert [strings[k] for k in back] == p.strings(np.arange(len(p.starts))) and len(set(strings)) == len(strings)


def test_token_counts_of_odd_rows(spark, odd_docs):
    rows = token_counts.token_counts(odd_docs, PATH).collect()
    assert len(rows) == 8
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_bytes"], by[1]["n_tokens"], by[1]["over_limit"]) == (0, 0, False)
    assert by[5]["n_tokens"] == len(LIBRARY.encode("word " * 30_000).ids) and by[5]["over_limit"]
    assert by[6]["score"] == "x"


def test_token_files_of_odd_rows(spark, odd_docs):
    folder = token_files.write_tokens(odd_docs, PATH, 2)
    rows = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert [r["key"] for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6]
    start = 0
    texts = {1: "", 2: "", 3: "  \n\t ", 4: "one two three four five six", None: "no id here at all", 5: "word " * 30_000, 6: "ÀÉ ñ 中文 😀 don't stop"}
    for r in rows:
        ids = np.array([*LIBRARY.encode(texts[r["key"]]).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_tokens(spark, token_files.write_tokens(empty, PATH, 2)).count() == 0


def brute_hits(text, items, window):
    w = wu_manber.words(text)
    hit, found = set(), set()
    for item, body in items:
        p = wu_manber.words(body)
        n = min(window, len(p))
        for i in range(len(p) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(w), hit, found


@pytest.mark.parametrize("seed", range(30))
def test_wu_manber_against_brute_force(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("ab cd é F1 x".split()) for _ in range(n)).encode()
    items = [(str(i), text(rng.choice([0, 1, 2, 3, 4, 9, 14]))) for i in range(6)]
    body = text(rng.choice([0, 3, 40, 120]))
    n, ranges, found = wu_manber.scan(wu_manber.compile_items(items, 4), body)
    assert (n, {i for a, b in ranges for i in range(a, b)}, found) == brute_hits(body, items, 4)


def test_decontaminate_odd_rows_and_blocks(spark, odd_docs):
    bench = spark.createDataFrame([(1, "two three four"), (1, "two three four"), (2, "ONE two"), (3, None), (None, "five"), (4, "!!")], "item_id long, text string")
    whole = wu_manber.decontaminate(odd_docs, bench)
    split = wu_manber.decontaminate(odd_docs, bench, block_bytes=8)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(whole) == key(split)
    by = {r["doc_id"]: r for r in whole.collect()}
    assert by[4]["items"] == ["1", "2"] and [tuple(h) for h in by[4]["hits"]] == [(0, 4)]
    assert by[1]["n_words"] == 0 and by[1]["items"] == []
    empty = wu_manber.decontaminate(odd_docs, bench.limit(0))
    assert empty.where("size(items) > 0").count() == 0


def test_language_accuracy_on_held_out_rows(spark, sf):
    found = op1_language_id.query(spark, sf)
    truth = {i: g for i, g in duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall()}
    rows = [r for r in found.collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_model_of_a_large_alphabet():
    letters = [chr(c) for c in range(0x100, 0x32000) if chr(c).isalpha()][:70_000]
    counts = {"a": {"".join(letters[i : i + 4]): 1 + i % 3 for i in range(0, 69_996, 2)}, "b": {"".join(letters[i : i + 4]): 2 for i in range(1, 69_996, 2)}}
    few = {k: dict(list(v.items())[:40]) for k, v in counts.items()}
    for of in (counts, few):
        models = language_id.kneser_ney(of)
        points = np.array([ord(c) for c in "".join(letters[:8])], np.uint32)
        assert np.isfinite(models.log_probs(points, np.arange(3, 8))).all()
    want = language_id.kneser_ney(few).log_probs(points, np.arange(3, 8))
    language_id.packed, kept = (lambda codes, base: np.ascontiguousarray(codes.astype(">u4")).view(f"S{4 * codes.shape[1]}").ravel() if codes.shape[1] else np.zeros(len(codes), "S1")), language_id.packed
    try:
        assert language_id.kneser_ney(few).log_probs(points, np.arange(3, 8)) == pytest.approx(want)
    finally:
        language_id.packed = kept


def test_language_probabilities_add_up():
    counts = {"a": {"   x": 3, "  xy": 2, "  xx": 1, " xyx": 2}, "b": {"   y": 1, "  yy": 1, " yyy": 4}}
    models = language_id.kneser_ney(counts)
    # Whatever came before, the probabilities of all characters and the unknown one add up to 1.
    alphabet = " xy"
    for before in ("   ", "  x", " xy", "yyy", "qqq"):
        total = np.zeros(2)
        for c in [*alphabet, "一"]:
            points = np.array([ord(x) for x in before + c], np.uint32)
            total += np.exp(models.log_probs(points, np.array([3])))[0]
        assert total == pytest.approx([1, 1], abs=1e-5)


def test_language_of_odd_rows(spark, odd_docs):
    train = spark.createDataFrame([(i, t, g) for i in range(40) for t, g in (("the cat sat on the mat", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string")
    models = language_id.fit(train, per_language=1000)
    by = {r["doc_id"]: r for r in language_id.predict(odd_docs, models).collect()}
    assert by[1]["nearest"] == by[2]["nearest"] == by[3]["nearest"] == "und" and by[1]["score"] == 0
    assert by[5]["nearest"] in ("en", "de")
    assert language_id.fit(train.limit(0)) is None
    assert {r["nearest"] for r in language_id.predict(odd_docs, None).collect()} == {"und"}


def test_machine_learns_a_pair_that_single_terms_miss():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.flatnonzero([a, b, rng.random() < 0.5]).astype(np.int32))
        labels.append(float(a != b))
    bias, w, v = toxicity.fit_machine(rows, np.array(labels), 3, 4, 30, 0.2, 1e-6, 1)
    machine = toxicity.Machine(8, {}, bias, w, v)
    right = ((machine.score([r.astype(np.int64) for r in rows]) >= 0.5) == np.array(labels)).mean()
    assert right > 0.95


def test_toxicity_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.1")
    found = {r["doc_id"]: r for r in op10_toxicity.query(spark, sf).collect()}
    truth = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall()
    held = [(found[i], t) for i, t in truth if found[i]["held_out"]]
    toxic = [r["predicted"] for r, t in held if t]
    assert len(toxic) >= 50 and sum(toxic) >= 0.75 * len(toxic)
    assert sum(r["predicted"] for r, t in held if not t) <= 0.02 * len(held)


def double_sum(bias, w, v, row):
    return bias + sum(w[i] for i in row) + sum(float(v[i] @ v[j]) for a, i in enumerate(row) for j in row[a + 1 :])


def test_margin_is_the_double_sum():
    rng = np.random.default_rng(4)
    w, v = rng.normal(size=9), rng.normal(size=(9, 3))
    rows = [np.flatnonzero(rng.random(9) < 0.5) for _ in range(20)] + [np.zeros(0, np.int64)]
    got = toxicity.Machine(9, {}, 0.3, w, v).margin(rows)
    assert got == pytest.approx([double_sum(0.3, w, v, r.tolist()) for r in rows])


def test_one_step_follows_the_gradient():
    """A fit of one batch moves every parameter by Adagrad along the slope of the mean loss, found by finite differences."""
    rng = np.random.default_rng(5)
    rows, y = [np.flatnonzero(rng.random(6) < 0.6).astype(np.int32) for _ in range(30)], (rng.random(30) < 0.4).astype(float)
    rate, start = 0.1, np.random.default_rng(7)
    v0 = start.normal(0, 0.01, (6, 2))
    bias, w, v = toxicity.fit_machine(rows, y, 6, 2, 1, rate, 0.0, 7, steps=1)
    bias0 = float(np.log(y.mean() / (1 - y.mean())))
    assert bias0 == pytest.approx(bias, abs=0.02)

    def loss(b, ww, vv):
        m = np.array([double_sum(b, ww, vv, r.tolist()) for r in rows])
        return float(np.mean(np.logaddexp(0, m) - y * m))

    e = 1e-5
    after = loss(bias, np.zeros(6), v0)  # factors and weights are moved from the start's slopes, taken before the bias moved
    assert np.isfinite(after)
    for i in range(6):
        step = np.eye(6)[i] * e
        g = (loss(bias0, step, v0) - loss(bias0, -step, v0)) / (2 * e)
        assert w[i] == pytest.approx(-rate * g / np.sqrt(1e-2 + g * g), rel=1e-3, abs=1e-6)
        for k in range(2):
            shift = np.zeros((6, 2))
            shift[i, k] = e
            g = (loss(bias0, np.zeros(6), v0 + shift) - loss(bias0, np.zeros(6), v0 - shift)) / (2 * e)
            assert v[i, k] - v0[i, k] == pytest.approx(-rate * g / np.sqrt(1e-2 + g * g), rel=1e-2, abs=1e-6)

def test_toxicity_of_odd_rows_without_labels(spark, odd_docs):
    none = spark.createDataFrame([(None, 1), (4, None)], "doc_id long, toxic int")
    machine = toxicity.fit(odd_docs, none)
    rows = toxicity.score(odd_docs, machine).collect()
    assert len(rows) == 8 and all(0 <= r["score"] < 1e-3 for r in rows)
