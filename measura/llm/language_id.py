"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is lower-cased, everything but letters and marks becomes one space, and each character is predicted from the
three before it.  The models' log-probabilities stand in hash arrays sorted by the 64-bit hash of an n-gram, with one
column for each language: an array for each order holds the interpolated values of all n-grams that any language has
shown, another the weights with which a context falls back to the shorter one.  The language with the lowest
cross-entropy per character is chosen; if that is above what texts of the language reach (a quantile on calibration
rows), the choice is marked as rejected.

What is bounded: fitting uses at most about ``per_language`` labelled rows of each language, chosen by a hash of their id; a
fifth of them calibrates where a language has ``CALIBRATE`` rows or more; one with fewer is fitted on all of them, and
nothing is rejected for it.  Prediction reads every whole text.

Edge cases: null texts and texts without letters are ``und`` with score 0; rows without id or language teach nothing;
without any labelled row every text is ``und``; equal cross-entropies go to the first language by name; repeated rows
are predicted alike.  Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.llm.textops import mix, slices
from measura.session import materialize

ORDER = 4
UNKNOWN = "und"
CALIBRATE = 25
#: Odd multipliers of the characters of an n-gram, the last character first.
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@cache
def letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


@cache
def plain_letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start, end): the normalised texts, each after ORDER - 1 spaces of padding; empty without letters."""
    points = np.frombuffer("\x00".join(["", *(t.lower().replace("\x00", " ") for t in texts), ""]).encode("utf-32-le"), "<u4").astype(np.uint32)
    cuts = np.flatnonzero(points == 0)
    word = letters()[points]
    keep = word.copy()
    keep[1:] |= ~word[1:] & word[:-1]  # the first character after a word stands for the space
    kept = np.where(word, points, 32)[keep]
    sums = np.concatenate([[0], np.cumsum(keep)])
    bounds = sums[cuts]
    sizes = np.diff(bounds)
    # A cut right after a word has been kept as that word's space; it belongs to the text before it.
    ends_kept = keep[cuts[1:]].astype(np.int64)
    begin, size = bounds[:-1] + keep[cuts[:-1]], sizes - keep[cuts[:-1]] + ends_kept
    pad = ORDER - 1
    ends = np.cumsum(size + pad)
    starts = ends - size
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint32)
    total = int(size.sum())
    run = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(starts, size) + run] = kept[np.repeat(begin, size) + run]
    return out, starts, ends


def gram_keys(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place from n - 1 on."""
    total = np.full(len(points) - n + 1, n, np.uint64)
    for back in range(n):
        total += (points[n - 1 - back : len(points) - back].astype(np.uint64) + np.uint64(1)) * STEPS[back]
    return mix(total)


@dataclass
class Level:
    keys: np.ndarray  # sorted
    values: np.ndarray  # one column for each language

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys


@dataclass
class Models:
    languages: list[str]
    grams: list[Level]  # by order - 1
    backoff: list[Level]  # by length of the context - 1
    floor: np.ndarray  # of a character that no language has shown
    limits: np.ndarray  # highest cross-entropy accepted, by language

    def log_probs(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log-probability of the character at each place under every language."""
        out = np.zeros((len(at), len(self.languages)))
        rows = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            keys = gram_keys(points, n)[at[rows] - n + 1]
            place, hit = self.grams[n - 1].find(keys)
            out[rows[hit]] += self.grams[n - 1].values[place[hit]]
            rows = rows[~hit]
            if not len(rows):
                return out
            if n > 1:
                place, hit = self.backoff[n - 2].find(gram_keys(points, n - 1)[at[rows] - 1 - (n - 1) + 1])
                out[rows[hit]] += self.backoff[n - 2].values[place[hit]]
        out[rows] += self.floor
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, nats per character under every language); no characters: infinite."""
        points, starts, ends = characters(texts)
        size = ends - starts
        # A text of marks alone has no letters.
        size = np.where(np.add.reduceat(np.append(plain_letters()[points], False), starts) * (size > 0) > 0, size, 0) if len(starts) else size
        sums = np.full((len(texts), len(self.languages)), np.inf)
        some = np.flatnonzero(size > 0)
        if len(some):
            at = np.concatenate([np.arange(starts[i], ends[i]) for i in some])
            cuts = np.cumsum(size[some]) - size[some]
            sums[some] = -np.add.reduceat(self.log_probs(points, at), cuts, axis=0) / size[some, None]
        return size, sums


def packed(codes: np.ndarray, base: int) -> np.ndarray:
    """A sortable key for each row of letter numbers: a whole number, or bytes where the alphabet is too large for one."""
    n = codes.shape[1]
    if base**ORDER < 1 << 63:
        return codes.astype(np.int64) @ (base ** np.arange(n - 1, -1, -1, dtype=np.int64))
    return np.ascontiguousarray(codes.astype(">u4")).view(f"S{4 * n}").ravel() if n else np.zeros(len(codes), "S1")


@dataclass
class Grams:
    """Distinct n-grams in ascending order of their keys."""

    codes: np.ndarray  # [grams, n]
    keys: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, base: int, weights: np.ndarray | None = None) -> tuple[Grams, np.ndarray]:
        """(the distinct rows, how often each occurs or its total weight)."""
        keys, first, back = np.unique(packed(codes, base), return_index=True, return_inverse=True)
        return cls(codes[first], keys), np.bincount(back.ravel(), weights, len(keys)).astype(np.float64)

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
        return place, self.keys[place] == sought

    def looked_up(self, values: np.ndarray, sought: np.ndarray) -> np.ndarray:
        place, hit = self.find(sought)
        return np.where(hit, values[place], 0.0)


def kneser_ney(counts: dict[str, dict[str, int]]) -> Models:
    """Models from the counts of ORDER-grams of every language."""
    languages = sorted(counts)
    alphabet = {c: i for i, c in enumerate(sorted({c for of in counts.values() for g in of for c in g}))}
    base = len(alphabet) + 1
    symbols = np.array([ord(c) for c in alphabet], np.uint32)
    # For every order and language: distinct n-grams with, for the highest order, counts and, below, continuation counts.
    grams: dict[int, list[tuple[Grams, np.ndarray]]] = {n: [] for n in range(1, ORDER + 1)}
    for name in languages:
        codes = np.array([[alphabet[c] for c in g] for g in counts[name]], np.int64).reshape(-1, ORDER)
        found, count = Grams.of(codes, base, np.array(list(counts[name].values()), np.float64))
        grams[ORDER].append((found, count))
        for n in range(ORDER - 1, 0, -1):
            found, count = Grams.of(found.codes[:, 1:], base)
            grams[n].append((found, count))
    floor = 1.0 / (len(alphabet) + 1)
    levels, backoff = [], []
    below_grams, below = None, np.full((1, len(languages)), floor)
    for n in range(1, ORDER + 1):
        union, _ = Grams.of(np.concatenate([g.codes for g, _ in grams[n]]), base)
        context = packed(union.codes[:, :-1], base)
        down = below[below_grams.find(packed(union.codes[:, 1:], base))[0]] if below_grams else np.full((len(union.keys), len(languages)), floor)
        values = np.empty((len(union.keys), len(languages)))
        contexts, _ = Grams.of(union.codes[:, :-1], base)
        weights = np.ones((len(contexts.keys), len(languages)))
        for k, (found, count) in enumerate(grams[n]):
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            own, total = Grams.of(found.codes[:, :-1], base, count)
            _, kinds = Grams.of(found.codes[:, :-1], base)
            of, kind = own.looked_up(total, context), own.looked_up(kinds, context)
            seen = found.looked_up(count, union.keys)
            safe = np.maximum(of, 1)
            values[:, k] = np.where(of > 0, (np.maximum(seen - discount, 0) + discount * kind * down[:, k]) / safe, down[:, k])
            of, kind = own.looked_up(total, contexts.keys), own.looked_up(kinds, contexts.keys)
            weights[:, k] = np.where(of > 0, discount * kind / np.maximum(of, 1), 1.0)
        levels.append(Level(*hashed(union.codes, symbols, np.log(values))))
        if n == 1:
            unseen = np.log(floor * weights[0])
        else:
            backoff.append(Level(*hashed(contexts.codes, symbols, np.log(weights))))
        below_grams, below = union, values
    return Models(languages, levels, backoff, unseen, np.full(len(languages), np.inf))


def hashed(codes: np.ndarray, symbols: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = codes.shape[1]
    points = symbols[codes[:, ::-1]]  # the last character first
    keys = mix(((points.astype(np.uint64) + np.uint64(1)) * STEPS[:n]).sum(1, dtype=np.uint64) + np.uint64(n))
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram, n) of the texts' ORDER-grams, added up for each batch."""
    for batch in batches:
        found: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            points, starts, _ = characters([text or ""])
            s = points.astype("<u4").tobytes().decode("utf-32-le")
            found.update((lang, s[i - ORDER + 1 : i + 1]) for i in range(int(starts[0]), len(s)))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, quantile: float = 0.995, slack: float = 0.1, seed: int = 3) -> Models | None:
    """Models from docs, which may hold any rows allowed for learning."""
    spark = docs.sparkSession
    known = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*(x for name, n in sizes.items() for x in (F.lit(name), F.lit(int(min(1.0, per_language / n) * (1 << 30))))))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(1 << 30))
    sample = materialize(known.where(draw < F.try_element_at(share, F.col("lang"))), "language-sample")
    few = [name for name, n in sizes.items() if n < CALIBRATE]
    aside = (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id").cast("string")), F.lit(5)) == 0) & ~F.col("lang").isin(few)
    counts: dict[str, dict[str, int]] = {}
    for r in sample.where(~aside).mapInArrow(gram_counter, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    if not counts:
        return None
    models = kneser_ney(counts)
    found = predict(sample.where(aside), models).where("n_letters > 0 AND nearest = lang")
    reach = {r["lang"]: r["q"] for r in found.groupBy("lang").agg(F.percentile("cross_entropy", F.lit(quantile)).alias("q")).collect()}
    models.limits = np.array([reach.get(name, np.inf) * (1 + slack) for name in models.languages])
    return models


OUT = [("nearest", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("cross_entropy", T.DoubleType(), pa.float64()), ("n_letters", T.LongType(), pa.int64()), ("rejected", T.BooleanType(), pa.bool_())]


def predictor(shared: Any, text: str, keep: list[str], evidence: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models | None = shared.value
        for batch in batches:
            texts = [t or "" for t in batch[text].to_pylist()]
            cols: tuple[list, ...] = ([], [], [], [], [])
            for a, b in slices([len(t) for t in texts], 500_000):
                if models is None:
                    n = b - a
                    new = [[UNKNOWN] * n, [0.0] * n, [None] * n, [0] * n, [True] * n]
                else:
                    size, nats = models.cross_entropies(texts[a:b])
                    some = size > 0
                    best = nats.argmin(1)
                    least = nats[np.arange(len(best)), best]
                    gap = np.where(some[:, None], nats - np.where(some, least, 0)[:, None], 0) * np.minimum(size, evidence)[:, None]
                    odds = 1 / np.exp(-np.minimum(gap, 700)).sum(1)
                    new = [
                        [models.languages[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)],
                        np.where(some, odds, 0.0).tolist(),
                        [float(x) if s else None for x, s in zip(least, some, strict=True)],
                        size.tolist(),
                        (~some | (least > models.limits[best])).tolist(),
                    ]
                for into, values in zip(cols, new, strict=True):
                    into += values
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(v, t) for v, (_, _, t) in zip(cols, OUT, strict=True))], names=[*keep, *(n for n, _, _ in OUT)])

    return run


def predict(docs: DataFrame, models: Models | None, text: str = "text", evidence: int = 50) -> DataFrame:
    """docs with nearest (the language of the lowest cross-entropy, or und), score (its share of the evidence of at
    most ``evidence`` characters), cross_entropy, n_letters (characters predicted) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    keep = [c for c in docs.columns if c not in {n for n, _, _ in OUT}]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    return docs.mapInArrow(predictor(shared, text, keep, evidence), T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t, _ in OUT)]))


def identify(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """docs with ``language``: the nearest language, or und where that is rejected."""
    found = predict(docs, models, text)
    return found.withColumn("language", F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("nearest")))
