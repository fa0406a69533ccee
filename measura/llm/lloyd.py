"""Centroid clustering on whole numbers with weighted deduplication.

Vectors are quantised to whole numbers, floor(scale * x).  Equal quantised vectors are grouped with their multiplicity; Lloyd's
rounds run over the distinct ones, adding each into its centroid as often as it occurs, and the assignments are joined back
to the rows.  Every step is exact, so the result doesn't depend on how the rows are spread.

* Distances: products of float64 while every value is below 2^22, where all sums stay below 2^53; Python's whole numbers
  beyond it.
* Sums: a task adds up its vectors for each centroid and emits them as signed digits of 40 bits, which Spark adds up by
  (centroid, component, digit); the driver gets these centroids times components, however many rows there are.
* Distinct vectors that hold more than 1 / HOT of the rows each, of which there are fewer than HOT, are joined to their
  rows by broadcast; the others, each a small part, by a shuffle on the vector itself.

Edge cases: vectors that are null, of another length, or hold null or non-finite components (also after scaling) take no
part.  Rows without an id can't start a centroid but are assigned.  Repeated rows count each time, also as starts.  Fewer
rows than centroids: as many centroids as there are rows; an empty table gives an empty result.  Distances and their sums that don't
fit 64 bits are returned as 2^63 - 1.  Columns of the input other than the id and the vector play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.session import drop_materialized, materialize

HOT = 256
SMALL = 1 << 22  # below it, distances are exact in float64
DIGIT = 40
MOST = (1 << 63) - 1
ROWS = 4096
MADE = "cluster int, centroid array<string>, centroid_sha256 string, rows long, inertia long, total long"


def packed(values: np.ndarray) -> list[bytes]:
    """One key for each row of whole-numbered float64: 32-bit words where they fit, else the float64 themselves."""
    fits = (np.abs(values) < 2**31).all(1)
    small = np.where(fits[:, None], values, 0).astype("<i4")
    return [small[i].tobytes() if ok else values[i].astype("<f8").tobytes() for i, ok in enumerate(fits)]


def unpacked(keys: list[bytes], dimension: int) -> np.ndarray:
    """float64 of the keys, a row for each."""
    if all(len(k) == 4 * dimension for k in keys):
        return np.frombuffer(b"".join(keys), "<i4").reshape(len(keys), dimension).astype(np.float64)
    return np.stack([np.frombuffer(k, "<i4" if len(k) == 4 * dimension else "<f8").astype(np.float64) for k in keys])


def quantising(dimension: int, scale: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
            with np.errstate(over="ignore"):
                q = np.floor(x * scale) + 0.0  # no negative zero
            fine = np.isfinite(q).all(1)
            keys = packed(q[fine]) if len(q) else []
            yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(fine)).cast(kind), pa.array(keys, pa.binary())], names=["id", "key"])

    return run


def quantised(vectors: DataFrame, key: str, embedding: str, dimension: int, scale: int) -> DataFrame:
    """(id, key) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    rows = rows.where((F.size("vector") == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    kind = T.StructType([rows.schema["id"], T.StructField("key", T.BinaryType())])
    return rows.mapInArrow(quantising(dimension, scale, arrow_type(rows)), kind)


def arrow_type(rows: DataFrame) -> pa.DataType:
    kind = rows.schema["id"].dataType
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]


def nearest(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """(smallest number of a nearest centroid, squared distance) of every point; exact."""
    large = max(float(np.abs(points).max(initial=0)), max(abs(c) for row in centroids for c in row))
    if large < SMALL:
        c = np.array(centroids, np.float64)
        d = (points * points).sum(1)[:, None] - 2 * (points @ c.T) + (c * c).sum(1)
        at = d.argmin(1)
        return at, d[np.arange(len(d)), at].astype(np.int64).tolist()
    best = [min((sum((int(p) - q) ** 2 for p, q in zip(point, c, strict=True)), k) for k, c in enumerate(centroids)) for point in points]
    return np.array([k for _, k in best], np.int64), [min(d, MOST) for d, _ in best]


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number in base 2^DIGIT, digits of its own sign."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if rest & ((1 << DIGIT) - 1):
            yield place, sign * (rest & ((1 << DIGIT) - 1))
        rest, place = rest >> DIGIT, place + 1


def adding(shared: Any, dimension: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's weighted sums: rows (cluster, component, place, digit); the component ``dimension`` is the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        sums = [[0] * (dimension + 1) for _ in centroids]
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                points, weights = unpacked(part["key"].to_pylist(), dimension), part["weight"].to_numpy(zero_copy_only=False)
                at, _ = nearest(points, centroids)
                exact = np.abs(points).max(initial=0) < SMALL and weights.max(initial=0) < 1 << 28  # 2^12 rows of these stay below 2^63
                whole = points.astype(np.int64) if exact else np.array([[int(x) for x in p] for p in points], object)
                for k in np.unique(at).tolist():
                    mine = at == k
                    w = weights[mine] if exact else weights[mine].astype(object)
                    new = [*(whole[mine] * w[:, None]).sum(0).tolist(), w.sum()]
                    sums[k] = [s + int(x) for s, x in zip(sums[k], new, strict=True)]
        rows = [(k, j, place, digit) for k, of in enumerate(sums) for j, total in enumerate(of) for place, digit in digits(total)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.int64())], names=["cluster", "component", "place", "digit"])

    return run


def assigning(shared: Any, dimension: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                at, d = nearest(unpacked(part["key"].to_pylist(), dimension), shared.value)
                yield pa.RecordBatch.from_arrays([part["key"], part["weight"], pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["key", "weight", "cluster", "distance"])

    return run


def moved(distinct: DataFrame, centroids: list[list[int]], dimension: int) -> list[list[int]]:
    """Centroids after one round: floors of weighted means; those without vectors stay."""
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)
    parts = distinct.mapInArrow(adding(shared, dimension), "cluster int, component int, place int, digit long")
    sums: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "place").agg(F.sum("digit").alias("digit")).collect():
        at = (r["cluster"], r["component"])
        sums[at] = sums.get(at, 0) + (r["digit"] << DIGIT * r["place"])
    shared.unpersist()
    return [[sums.get((k, j), 0) // sums[k, dimension] for j in range(dimension)] if (k, dimension) in sums else c for k, c in enumerate(centroids)]


def starts(rows: DataFrame, clusters: int, seed: int, dimension: int) -> list[list[int]]:
    """The vectors of the rows with the smallest SHA-256 of ``seed:id`` (ties: the smaller key)."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    first = rows.where("id IS NOT NULL").orderBy(digest, "key").limit(clusters).collect()
    return [[int(x) for x in unpacked([bytes(r["key"])], dimension)[0]] for r in first]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, key: str = "vec_id", embedding: str = "embedding", dimension: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """((id, cluster, distance) of the rows that take part, (cluster, centroid, centroid_sha256, rows, inertia, total)).

    A centroid is listed in decimal digits, which its SHA-256 is taken of, joined by commas; inertia is the distance summed over a cluster's rows, total over all rows.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, key, embedding, dimension, scale), "lloyd-rows")
    distinct = materialize(rows.groupBy("key").agg(F.count("*").alias("weight")), "lloyd-distinct")
    centroids = starts(rows, clusters, seed, dimension)
    if not centroids and rows.isEmpty():
        return spark.createDataFrame([], T.StructType([rows.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])), spark.createDataFrame([], MADE)
    if not centroids:  # no row has an id
        centroids = [[0] * dimension]
    for _ in range(rounds):
        centroids = moved(distinct, centroids, dimension)
    assigned = materialize(distinct.mapInArrow(assigning(spark.sparkContext.broadcast(centroids), dimension), "key binary, weight long, cluster int, distance long"), "lloyd-assigned")
    exact = F.col("distance").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")
    found = {r["cluster"]: (r["n"], int(r["inertia"])) for r in assigned.groupBy("cluster").agg(F.sum("weight").alias("n"), F.sum(exact).alias("inertia")).collect()}
    total = min(sum(i for _, i in found.values()), MOST)
    table = [(k, digest(c), *(found.get(k, (0, 0))), total) for k, c in enumerate(centroids)]
    centres = spark.createDataFrame([(k, [str(x) for x in c], h, n, min(i, MOST), t) for (k, h, n, i, t), c in zip(table, centroids, strict=True)], MADE)
    count = sum(n for n, _ in found.values())
    hot = F.col("weight") * HOT > F.lit(count)
    common, rare = assigned.where(hot).select("key", "cluster", "distance"), assigned.where(~hot).select("key", "cluster", "distance")
    # Fewer than HOT keys: a bound that no table changes.
    often = rows.join(F.broadcast(common), "key")
    seldom = rows.join(F.broadcast(common.select("key")), "key", "left_anti").join(rare, "key")
    drop_materialized(spark, distinct)
    return often.unionByName(seldom).select("id", "cluster", "distance"), centres
