"""Quality by Bradley-Terry pairwise ranking.

A text becomes features: shares of kinds of characters, of repeated words and lines, and of the shapes of its words (``Aa+.``
for ``Then.``), hashed into ``buckets``.  Of two labelled texts with different labels the one with the higher label is
preferred, with probability

    P(i before j) = 1 / (1 + exp(-(w x_i - w x_j))),

so the weights are learnt by logistic loss on feature differences of preference pairs, and w x ranks every text.  The ranking
is cut at a quantile: among all labelled rows allowed for learning, as large a share lies below the cut as has less than
the highest label.  The score is logistic in the distance from the cut, and equals ``keep`` there.

What is bounded: the weights are fitted on at most about ``max_rows`` labelled rows, chosen by a hash of their id, and on
``steps`` batches of ``batch`` pairs drawn uniformly from all preference pairs of these.  The quantile covers all labelled
rows, and scoring reads every whole text.

Edge cases: null and empty texts have features of nothing and get a score as any text; words are counted in blocks, so a
very long text needs no more memory than itself; rows with a null label or id teach nothing; a repeated id teaches by its
largest label, and the weights by one of its texts; repeated documents are scored alike; without labels of two kinds every score is the share of
the highest label (0 without labels).  Ties at the cut are on its upper side.  Input columns named like an output column are
replaced by it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from operator import eq
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.llm.textops import parts
from measura.session import materialize

BLOCK = 500  # words among which repetition is counted
PIECE = 1_000_000  # characters whose words are Python objects at once
MEMO, SHORT = 100_000, 32  # words whose shapes a worker keeps, and their longest
FIXED = 16  # features beside the shapes
RUN = re.compile(r"(.)\1+", re.S)
TIE = 1e-12  # of the score's odds, so that rounding leaves the cut itself on its upper side
DIGITS = 1_000_000  # accuracy of the quantile: an error of one in so many ranks


def shape(word: str) -> str:
    """Kinds of the word's characters, runs marked by +; what is no letter and no digit stands for itself."""
    return RUN.sub(r"\1+", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters that end at blanks; a longer word is in one piece."""
    at = 0
    while len(text) - at > PIECE:
        cut = re.compile(r"\s").search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


class Features:
    def __init__(self, buckets: int) -> None:
        self.buckets, self.memo = buckets, {}

    def bucket(self, word: str) -> int:
        found = self.memo.get(word)
        if found is None:
            found = zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % self.buckets
            if len(word) <= SHORT:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of a text's features."""
        words = chars = same = fresh = top = ended = single = lines = 0
        kinds, shapes, seen, repeated = Counter(), Counter(), set(), 0
        last = None
        for piece in pieces(text):
            kinds.update(piece)
            for line in piece.split("\n"):
                lines += 1
                mark = zlib.crc32(line.encode("utf-8", "surrogatepass")) if line.strip() else None
                repeated += len(line) if mark in seen else 0
                if mark is not None:
                    seen.add(mark)
            of = piece.split()
            for a in range(0, len(of), BLOCK):
                part = of[a : a + BLOCK]
                counts = Counter(part)
                fresh += len(counts)
                top += max(counts.values())
                same += sum(map(eq, part, part[1:])) + (part[0] == last)
                last = part[-1]
                for word, n in counts.items():
                    shapes[self.bucket(word)] += n
                    single += n if len(word) == 1 else 0
                    chars += n * len(word)
                    ended += n if word[-1] in ".!?" else 0
            words += len(of)
        size = max(1, len(text))
        share = lambda fits: sum(n for c, n in kinds.items() if fits(c)) / size
        w = max(1, words)
        entropy = -sum(n / size * math.log(n / size) for n in kinds.values())
        fixed = [
            math.log1p(words), share(str.isupper), share(str.islower), share(str.isdigit), share(str.isspace), share(lambda c: not (c.isalnum() or c.isspace())), share(lambda c: c > "\x7f"),
            chars / w / 10, fresh / w, same / w, top / w, ended / w, single / w, lines / w, repeated / size, entropy,
        ]
        found = sorted(shapes)
        return np.array([*range(FIXED), *(FIXED + b for b in found)], np.int32), np.array([*fixed, *(math.sqrt(shapes[b] / w) for b in found)], np.float32)


@dataclass
class Ranker:
    buckets: int
    weights: np.ndarray | None  # None: nothing to learn from
    share: float  # of the highest label
    cut: float = 0.0
    keep: float = 0.7

    def margin(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        return np.array([float(self.weights[at] @ values.astype(np.float64)) for at, values in rows])

    def score(self, margin: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(margin), self.share)
        return 1 / (1 + np.exp(-np.clip(margin - self.cut, -30, 30)) * ((1 - self.keep) / self.keep * (1 - TIE)))


def preferences(labels: np.ndarray, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other): ``count`` pairs drawn uniformly from all pairs of rows with different labels."""
    better, worse = [], []
    while count > 0:
        a, b = rng.integers(0, len(labels), (2, 4 * count))
        fine = np.flatnonzero(labels[a] != labels[b])[:count]
        a, b = a[fine], b[fine]
        up = labels[a] > labels[b]
        better.append(np.where(up, a, b))
        worse.append(np.where(up, b, a))
        count -= len(fine)
    return np.concatenate(better), np.concatenate(worse)


def pair_loss(weights: np.ndarray, differences: np.ndarray, shrink: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of preferred minus other, with its gradient."""
    m = differences @ weights
    loss = np.logaddexp(0, -m).mean() + shrink / 2 * weights @ weights
    return float(loss), -(differences * (1 / (1 + np.exp(np.clip(m, -30, 30))))[:, None]).mean(0) + shrink * weights


def bradley_terry(x: np.ndarray, labels: np.ndarray, steps: int, batch: int, rate: float, shrink: float, seed: int) -> np.ndarray:
    """Weights by Adagrad on batches of preference pairs; columns are scaled by their spread."""
    rng = np.random.default_rng(seed)
    spread = x.std(0)
    used = np.flatnonzero(spread)  # a column without differences teaches nothing
    scale = 1 / np.maximum(spread[used], 1e-2)
    x = x[:, used] * scale
    weights, seen = np.zeros(len(used)), np.full(len(used), 1e-6)
    for _ in range(steps):
        better, worse = preferences(labels, batch, rng)
        _, slope = pair_loss(weights, x[better] - x[worse], shrink)
        seen += slope * slope
        weights -= rate * slope / np.sqrt(seen)
    out = np.zeros(len(spread))
    out[used] = weights * scale
    return out


def featured(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            found = [features.of(t or "") for _, _, part in parts(batch["text"]) for t in part.to_pylist()]
            places, values = ([pair[k].tobytes() for pair in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["id", "label", "places", "values"])

    return run


def known(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, label) with one row for each id."""
    return labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_rows: int = 20_000, buckets: int = 1024, steps: int = 1500, batch: int = 512, rate: float = 0.1, shrink: float = 1e-4, seed: int = 13
) -> Ranker:
    """Fits on at most about max_rows rows of ``labels`` (key, label), which may hold any rows allowed for learning; the cut is not set."""
    told = known(labels, key, label)
    total = told.count()
    if total > max_rows:
        told = told.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(max_rows / total * (1 << 30)))
    sample = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(told), "id").select("id", "label", "text")
    kind = T.StructType([sample.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("values", T.BinaryType())])
    one = sample.mapInArrow(featured(buckets), kind).groupBy("id").agg(F.min(F.struct("label", "places", "values")).alias("r"))
    rows = sorted((r["id"], r["r"]["label"], bytes(r["r"]["places"]), bytes(r["r"]["values"])) for r in one.collect())
    found = np.array([r[1] for r in rows], np.int64)
    if len(set(found.tolist())) < 2:
        return Ranker(buckets, None, float((found > 0).mean()) if len(found) else 0.0)
    x = np.zeros((len(rows), FIXED + buckets), np.float32)
    for i, (_, _, places, values) in enumerate(rows):
        x[i, np.frombuffer(places, np.int32)] = np.frombuffer(values, np.float32)
    return Ranker(buckets, bradley_terry(x, found, steps, batch, rate, shrink, seed), float((found == found.max()).mean()))


def measuring(shared: Any, text: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker: Ranker = shared.value
        features = Features(ranker.buckets)
        for batch in batches:
            found = [ranker.margin([features.of(t or "")])[0] for _, _, part in parts(batch[text]) for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(found, pa.float64())], names=[*keep, "margin"])

    return run


def margins(docs: DataFrame, ranker: Ranker, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with margin, the place on the ranking's scale."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "margin"]
    used = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])))
    kind = T.StructType([*(used.schema[c] for c in keep), T.StructField("margin", T.DoubleType())])
    return used.mapInArrow(measuring(shared, text, keep), kind)


def cut(ranked: DataFrame, labels: DataFrame, ranker: Ranker, key: str = "doc_id", label: str = "quality") -> Ranker:
    """The ranker with its cut: the quantile of all labelled rows' margins at the share of rows below the highest label.

    It lies halfway between the margins on either side of the quantile.
    """
    if ranker.weights is None:
        return ranker
    of = ranked.select(F.col(f"`{key}`").alias("id"), "margin").join(known(labels, key, label), "id")
    sizes = {r["label"]: r["n"] for r in of.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    below = total - sizes[max(sizes)]
    ends = of.agg(F.percentile_approx("margin", F.array(F.lit(below / total), F.lit(min(1.0, (below + 1) / total))), DIGITS).alias("ends")).first()["ends"]
    return replace(ranker, cut=sum(ends) / 2)


def scored(ranked: DataFrame, ranker: Ranker) -> DataFrame:
    """What margins() gave with score, between 0 and 1."""
    if ranker.weights is None:
        return ranked.withColumn("score", F.lit(ranker.share))
    away = F.least(F.greatest(F.col("margin") - ranker.cut, F.lit(-30.0)), F.lit(30.0))
    return ranked.withColumn("score", 1 / (1 + F.exp(-away) * ((1 - ranker.keep) / ranker.keep * (1 - TIE))))


def rank(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``, among them the key) with margin and score, learnt from ``labels``."""
    ranker = fit(docs, labels, text, key, label)
    ranked = materialize(margins(docs, ranker, text, keep), "ranking-margins")
    return scored(ranked, cut(ranked, labels, ranker, key, label))
