"""Nearest neighbours by randomly rotated one-bit codes with error bounds (Euclidean distance).

Index: each vector is taken relative to its nearest centre, rotated by a random orthogonal matrix, and kept as the signs
of its coordinates, packed in 64-bit words, with two scalars: its distance to the centre and the inner product of
its direction with its code.  Search: a query is rotated alike and rounded to 4-bit planes; popcounts of code AND
plane estimate the inner product of directions, and with the scalars the distance.  The estimate's error is bounded by
``confidence / sqrt(dimension - 1)`` times a factor of the scalars; vectors whose lower bound reaches the k-th
distance found so far are measured exactly, in double precision on the original vectors.

What is bounded: centres and rotation are fitted on about ``sample`` vectors chosen by a hash of their id; every row is
indexed.  Queries are searched in blocks of at most about ``block`` (one broadcast each), each against all rows.
Equal vectors are measured once for each block of rows, and equal queries once.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and ids that are null, take no part,
nor do vectors of another length than the commonest (ties: the shorter).  Ties go to the smaller id.  A row that is
repeated with its vector counts once; a query never finds its own id.  An id with several vectors asks with each of them:
every list holds k rows of other ids, and the lists stand under the one id.  Fewer candidates than k: all are returned.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from measura.session import materialize

PLANES = 4
ROWS = 4096  # vectors taken at once


@dataclass
class Index:
    dimension: int
    centres: np.ndarray
    rotation: np.ndarray  # of the padded dimension

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, len(self.rotation) - self.dimension))) @ self.rotation.T


def fit_index(vectors: np.ndarray, centres: int, rounds: int, seed: int) -> Index:
    """A random rotation, and centres by a few rounds of k-means on the sample."""
    rng = np.random.default_rng(seed)
    n, d = vectors.shape
    padded = -(-d // 64) * 64
    rotation, upper = np.linalg.qr(rng.normal(size=(padded, padded)))
    rotation = rotation * np.sign(np.diag(upper))
    points = np.unique(vectors, axis=0)
    found = points[rng.permutation(len(points))[:centres]]
    for _ in range(rounds):
        nearest = closest(vectors, found)
        for k in range(len(found)):
            if (nearest == k).any():
                found[k] = vectors[nearest == k].mean(0)
    return Index(d, found, rotation)


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def codes(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(centre, packed signs, distance to the centre, inner product of direction and code)."""
    at = closest(x, index.centres)
    rest = x - index.centres[at]
    norm = np.sqrt((rest * rest).sum(1))
    direction = index.rotated(rest / np.maximum(norm, 1e-30)[:, None])
    signs = direction > 0
    agree = np.abs(direction).sum(1) / np.sqrt(direction.shape[1])
    return at, np.packbits(signs, axis=1, bitorder="little").view("<u8"), norm, np.where(norm > 0, agree, 1.0)


def lower_bounds(index: Index, queries: np.ndarray, at: np.ndarray, code: np.ndarray, norm: np.ndarray, agree: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, lower bounds) of the squared distances, [vectors, queries]."""
    d = len(index.rotation)
    estimate, slack = np.empty((len(code), len(queries)), np.float32), np.empty((len(code), len(queries)), np.float32)
    for c in np.unique(at):
        rows = np.flatnonzero(at == c)
        rest = queries - index.centres[c]
        size = np.sqrt((rest * rest).sum(1))
        turned = index.rotated(rest / np.maximum(size, 1e-30)[:, None])
        low = turned.min(1)
        width = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-30)
        levels = np.rint((turned - low[:, None]) / width[:, None]).astype(np.uint8)
        planes = [np.packbits((levels >> b) & 1, axis=1, bitorder="little").view("<u8") for b in range(PLANES)]
        dots = np.zeros((len(rows), len(queries)), np.float32)
        ones = np.bitwise_count(code[rows]).sum(1).astype(np.float32)
        for word in range(code.shape[1]):
            for b, plane in enumerate(planes):
                dots += np.bitwise_count(code[rows, word][:, None] & plane[:, word][None, :]).astype(np.float32) * np.float32(1 << b)
        # <code, query>, where a code's coordinates are +-1/sqrt(d).
        inner = (2 * (dots * width + low * ones[:, None]) - turned.sum(1)) / np.sqrt(d)
        cosine = inner / agree[rows][:, None]
        pair = 2 * norm[rows][:, None] * size
        estimate[rows] = norm[rows][:, None] ** 2 + size**2 - pair * cosine
        spread = np.sqrt(np.maximum(1 - agree[rows] ** 2, 0)) / agree[rows]
        # The rounding of the query to planes moves an inner product by half a level for each coordinate at most.
        rounding = width / 2 * confidence / agree[rows][:, None]
        slack[rows] = pair * (confidence * spread[:, None] / np.sqrt(max(d - 1, 1)) + rounding)
    return estimate, estimate - slack


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    diff = x - q
    return np.sqrt((diff * diff).sum(1))


@dataclass
class Queries:
    ids: np.ndarray  # one for each list
    vectors: np.ndarray
    own: list[int | None]  # the id whose rows are left out, where a list is of one id


def indexer(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["vector"], index.dimension)
            at, code, norm, agree = codes(index, x)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["vector"], pa.array(at, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm, pa.float64()), pa.array(agree, pa.float64())],
                names=["id", "vector", "centre", "code", "norm", "agree"],
            )

    return run


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def searcher(shared: Any, keep: int, confidence: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, queries = shared.value
        n = len(queries.ids)
        best_d, best_i = [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                ids, x = part["id"].to_numpy(), matrix(part["vector"], index.dimension)
                code = np.frombuffer(b"".join(part["code"].to_pylist()), "<u8").reshape(len(ids), -1)
                at, norm, agree = part["centre"].to_numpy(), part["norm"].to_numpy(), part["agree"].to_numpy()
                # Equal vectors: one is measured, and the smallest ids stand for the rest, which rank behind them.
                distinct, first, back = np.unique(x, axis=0, return_index=True, return_inverse=True)
                back = back.ravel()
                order = np.lexsort((ids, back))
                group = back[order]
                start = np.searchsorted(group, np.arange(len(distinct) + 1))
                # Distinct vectors that only rows of a list's own id have.
                hidden = {j: np.bincount(back[ids == i], minlength=len(distinct)) == np.diff(start) for j, i in enumerate(queries.own) if i is not None}
                for b in range(0, n, 512):
                    q = queries.vectors[b : b + 512]
                    estimate, low = lower_bounds(index, q, at[first], code[first], norm[first], agree[first], confidence)
                    for j in range(len(q)):
                        if b + j in hidden:
                            estimate[hidden[b + j], j] = low[hidden[b + j], j] = np.inf
                    near = np.argpartition(estimate, min(keep, len(distinct)) - 1, axis=0)[: min(keep, len(distinct))]
                    for j in range(len(q)):
                        own, close = queries.own[b + j], near[:, j]
                        if own is not None:
                            close = close[~hidden[b + j][close]]
                        sure = exact(distinct[close], q[j])
                        held = np.sort(np.concatenate([best_d[b + j], sure]))
                        limit = held[keep - 1] if len(held) >= keep else np.inf
                        rows = np.flatnonzero(low[:, j] <= limit * limit * (1 + 1e-6) + 1e-6)
                        rows = np.union1d(rows, close)
                        if own is not None:
                            rows = rows[~hidden[b + j][rows]]
                        dist = exact(distinct[rows], q[j])
                        fine = dist <= limit
                        of = [ids[order[start[r] : min(start[r] + keep, start[r + 1])]] for r in rows[fine]] if own is None else [(x := ids[order[start[r] : start[r + 1]]])[x != own][:keep] for r in rows[fine]]
                        d = np.concatenate([*(np.repeat(v, len(x)) for x, v in zip(of, dist[fine], strict=True)), best_d[b + j]])
                        i = np.concatenate([*of, best_i[b + j]])
                        top = np.lexsort((i, d))
                        # A repeated row is one candidate.
                        i, d = i[top], d[top]
                        new = np.append(True, (i[1:] != i[:-1]) | (d[1:] != d[:-1])) if len(i) else np.zeros(0, bool)
                        best_d[b + j], best_i[b + j] = d[new][:keep], i[new][:keep]
        sizes = [len(d) for d in best_d]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(queries.ids, sizes), pa.int64()), pa.array(np.concatenate([*best_i, np.zeros(0, np.int64)]).astype(np.int64), pa.int64()), pa.array(np.concatenate([*best_d, np.zeros(0)]), pa.float64())],
            names=["query", "id", "score"],
        )

    return run


def usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, vector) of the rows that take part, all of one length."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & fine)
    common = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (common[0]["n"] if common else 0))


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", embedding: str = "embedding", k: int = 10, sample: int = 8192, centres: int = 16, rounds: int = 5, confidence: float = 3.0, block: int = 4096, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row for which is_query (over ``id``) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, embedding)
    total = rows.count()
    draw = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30)))
    fitted_on = np.array([r["vector"] for r in sorted(draw.collect(), key=lambda r: (r["id"], r["vector"]))] or [r["vector"] for r in rows.limit(1).collect()])
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    index = fit_index(fitted_on, centres, rounds, seed)
    stored = materialize(rows.mapInArrow(indexer(spark.sparkContext.broadcast(index)), "id long, vector array<double>, centre int, code binary, norm double, agree double"), "one-bit-index")
    asked = stored.where(is_query).select("id", "vector").distinct()
    # Ids with one vector share the lists of equal vectors, of k + 1 rows; each vector of another id has its own.
    several = asked.groupBy("id").agg((F.count("*") > 1).alias("several"))
    asked = materialize(asked.join(several, "id").select("id", "vector", F.when(F.col("several"), F.col("id")).alias("own")), "one-bit-asked")
    blocks = max(1, -(-asked.count() // block))  # of at most about block lists
    out = empty
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vector"), F.lit(blocks)) == b)
        first = part.groupBy("vector", "own").agg(F.min("id").alias("least"))
        mine = sorted((r["least"], r["vector"], r["own"] is not None) for r in first.collect())
        if not mine:
            continue
        queries = Queries(np.arange(len(mine)), np.array([v for _, v, _ in mine]), [i if alone else None for i, _, alone in mine])
        first = spark.createDataFrame([(n, v, i if alone else None) for n, (i, v, alone) in enumerate(mine)], "query long, vector array<double>, own long")
        found = stored.select("id", "vector", "centre", "code", "norm", "agree").mapInArrow(searcher(spark.sparkContext.broadcast((index, queries)), k + 1, confidence), "query long, id long, score double")
        best = found.distinct().withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("score", "id"))).where(F.col("place") <= k + 1)
        # At most block lists of k + 1 rows, and block vectors: both are broadcast to the ids that ask for them.
        lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))
        asking = part.alias("p").join(F.broadcast(first).alias("f"), (F.col("p.vector") == F.col("f.vector")) & F.col("p.own").eqNullSafe(F.col("f.own")))
        lists = asking.select("query", F.col("p.id").alias("query_id")).join(F.broadcast(lists), "query")
        own = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
        ranked = lists.select("query_id", F.posexplode(own).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
        out = ranked if out is empty else out.unionByName(ranked)
    return out
