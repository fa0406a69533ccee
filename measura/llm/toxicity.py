"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and the beginnings of its words (4 to 6 characters), hashed into ``buckets``.
Terms are chosen on labelled rows by the likelihood ratio of their presence; the machine

    y(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

is fitted to the presence of the chosen ones, so that a pair of terms can mean more than its parts.  The score is the
logistic of y.

What is bounded: fitting uses at most about ``max_rows`` labelled rows, chosen by a hash of their id, and the model holds
``terms`` terms.  Scoring reads every whole text.

Edge cases: null and empty texts have no terms and get the score of the bias; rows with a null label or id teach
nothing; a repeated id teaches by its largest label; repeated documents are scored alike; without labels of both kinds
every score is the base rate (0 if there are none).  Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.llm.textops import encoded, parts
from measura.llm.wu_manber import words
from measura.session import materialize

PREFIXES = (4, 5, 6)
MEMO = 100_000  # words whose terms a worker keeps
BATCH = 256  # rows of a step


def term_buckets(word: bytes, buckets: int) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings; a beginning ends between characters."""
    chars = word.decode("utf-8", "replace")
    parts = [b"w" + word, *(b"p%d" % n + chars[:n].encode() for n in PREFIXES if len(chars) >= n)]
    return tuple(zlib.crc32(p) % buckets for p in parts)


class Terms:
    """Distinct chosen terms of a text; ``index`` maps bucket to column (None: every bucket is its own)."""

    def __init__(self, buckets: int, index: dict[int, int] | None = None) -> None:
        self.buckets, self.index, self.memo = buckets, index, {}

    def of(self, text: bytes) -> set[int]:
        memo, out = self.memo, set()
        for word in set(words(text)):
            found = memo.get(word)
            if found is None:
                found = term_buckets(word, self.buckets)
                if self.index is not None:
                    found = tuple(self.index[b] for b in found if b in self.index)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[word] = found
            out.update(found)
        return out


@dataclass
class Machine:
    buckets: int
    index: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, bounds = ragged(rows)
        y = np.full(len(rows), self.bias)
        if len(flat):
            who = np.repeat(np.arange(len(rows)), np.diff(bounds))
            v = self.factors[flat]
            y += np.bincount(who, self.weights[flat], len(rows))
            for k in range(v.shape[1]):
                y += 0.5 * (np.bincount(who, v[:, k], len(rows)) ** 2 - np.bincount(who, v[:, k] ** 2, len(rows)))
        return y

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def ragged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.cumsum([0, *map(len, rows)])
    return (np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)).astype(np.int64), bounds


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, columns: int, rank: int, epochs: int, rate: float, shrink: float, seed: int, steps: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """Adagrad on the logistic loss, in mini-batches of an order fixed by the seed, for the epochs or ``steps`` if those are more."""
    rng = np.random.default_rng(seed)
    rate_pos = labels.mean()
    bias = float(np.log(rate_pos / (1 - rate_pos)))
    w, v = np.zeros(columns), rng.normal(0, 0.01, (columns, rank))
    gw, gv, gb = np.full(columns, 1e-2), np.full((columns, rank), 1e-2), 1e-2
    for _ in range(max(epochs, -(-steps // max(1, -(-len(rows) // BATCH))))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            flat, bounds = ragged([rows[i] for i in part])
            who = np.repeat(np.arange(len(part)), np.diff(bounds))
            vs = v[flat]
            sums = np.stack([np.bincount(who, vs[:, k], len(part)) for k in range(rank)], 1)
            squares = np.bincount(who, (vs * vs).sum(1), len(part))
            y = bias + np.bincount(who, w[flat], len(part)) + 0.5 * ((sums * sums).sum(1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]
            g = slope.mean()
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if not len(flat):
                continue
            used, inverse = np.unique(flat, return_inverse=True)
            per = slope[who] / len(part)
            g = np.bincount(inverse, per, len(used)) + shrink * w[used]
            gw[used] += g * g
            w[used] -= rate * g / np.sqrt(gw[used])
            pull = per[:, None] * (sums[who] - vs)
            g = np.stack([np.bincount(inverse, pull[:, k], len(used)) for k in range(rank)], 1) + shrink * v[used]
            gv[used] += g * g
            v[used] -= rate * g / np.sqrt(gv[used])
    return bias, w, v


def counter(text: str, label: str, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (bucket, pos, neg): in how many texts of either label a term occurs, added up for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(buckets)
        for batch in batches:
            pos, neg = {}, {}
            for body, y in zip(encoded(batch[text]), batch[label].to_pylist(), strict=True):
                into = pos if y else neg
                for t in terms.of(body):
                    into[t] = into.get(t, 0) + 1
            keys = sorted(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([pos.get(k, 0) for k in keys], pa.int64()), pa.array([neg.get(k, 0) for k in keys], pa.int64())], names=["bucket", "pos", "neg"]
            )

    return run


def chooser(text: str, label: str, buckets: int, index: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(buckets, index)
        for batch in batches:
            rows = [np.array(sorted(terms.of(b)), np.int32).tobytes() for b in encoded(batch[text])]
            yield pa.RecordBatch.from_arrays([batch["id"], batch[label].cast(pa.int32()), pa.array(rows, pa.binary())], names=["id", "label", "terms"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_rows: int = 20_000, buckets: int = 1 << 20, terms: int = 3000, least: int = 4, rank: int = 6, epochs: int = 12, rate: float = 0.1, shrink: float = 1e-5, seed: int = 11, steps: int = 1500
) -> Machine:
    """Fits on at most about max_rows rows of ``labels`` (key, label), which may hold any rows allowed for learning, for
    ``epochs`` or, where few rows make those short, ``steps`` steps."""
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(max_rows / total * (1 << 30)))
    sample = materialize(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "id"), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return Machine(buckets, {}, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, rank)))
    p, n = sizes[1], sizes[0]
    # Signed-free likelihood ratio of presence against label, from the four counts of a term.
    cell = lambda seen, of: F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)
    both, share_p, share_n = F.col("pos") + F.col("neg"), p / (p + n), n / (p + n)
    ratio = cell(F.col("pos"), both * share_p) + cell(F.col("neg"), both * share_n) + cell(p - F.col("pos"), (p + n - both) * share_p) + cell(n - F.col("neg"), (p + n - both) * share_n)
    best = (
        sample.mapInArrow(counter("text", "label", buckets), "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(both >= least).orderBy(ratio.desc(), "bucket").limit(terms)
    )
    index = {r["bucket"]: i for i, r in enumerate(best.select("bucket").collect())}
    rows = sample.mapInArrow(chooser("text", "label", buckets, index), "id long, label int, terms binary").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["terms"])))
    fitted = fit_machine([np.frombuffer(bytes(r["terms"]), np.int32) for r in rows], np.array([r["label"] for r in rows], float), len(index), rank, epochs, rate, shrink, seed, steps)
    return Machine(buckets, index, *fitted)


def scorer(shared: Any, text: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine = shared.value
        terms = Terms(machine.buckets, machine.index)
        for batch in batches:
            # A part of the texts at a time: the factors of all their terms are held at once.
            found = [machine.score([np.array(sorted(terms.of(b)), np.int64) for b in encoded(part)]) for _, _, part in parts(batch[text])]
            score = np.concatenate([*found, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(score, pa.float64())], names=[*keep, "score"])

    return run


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with score, between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    keep = [c for c in docs.columns if c != "score"]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    return docs.mapInArrow(scorer(shared, text, keep), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
