"""Lattices lifted, coded, sealed and stored by blocks, and proved from what is stored alone.

A block of the lattice goes to a task with a border of its neighbours' places, so that its coefficients are those of the whole
lattice (see measura.functions.tower); it is stored as Rice codes with the first bit of each code block, and the SHA-256 of
its lanes.  To read, blocks are unpacked, coefficients meet the blocks whose borders they lie in, and each block is lowered.  To
prove, a sample's root, the SHA-256 of its blocks' digests in order, is computed again from the lanes that were lowered and
compared with what was kept beside the codes.

A place is sent to the blocks whose borders hold it: the border is ``tower.halo(levels)`` wide, so blocks should be several times as
wide where lattices are large.

Edge cases: absent places are 0, and blocks without places near them aren't stored; lanes are whole numbers below 2^16; places outside the extents fail the query; a sample without
places has no blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measura.functions import coding, tower

AXES = ("t", "y", "x")
STORED = "sample long, bt int, by int, bx int, lanes long, bits long, firsts binary, payload binary, digest string"


def own(axis: str, block: int) -> Column:
    return F.floor(F.col(axis) / block).cast("int")


def bordered(cells: DataFrame, value: str, extents: tuple[int, ...], blocks: tuple[int, ...], border: int) -> DataFrame:
    """(sample, t, y, x, value, bt, by, bx): every place for each block that holds it or has it in its border."""
    out = cells.select("sample", *AXES, value)
    inside = [F.col(a).between(0, n - 1) for a, n in zip(AXES, extents, strict=True)]
    out = out.withColumn(value, F.when(inside[0] & inside[1] & inside[2], F.col(value)).otherwise(F.raise_error(F.lit("a place outside the extents")).cast("long")))
    for a, n, b in zip(AXES, extents, blocks, strict=True):
        last = -(-n // b) - 1
        low, high = F.greatest(F.floor((F.col(a) - border) / b), F.lit(0)), F.least(F.floor((F.col(a) + border) / b), F.lit(last))
        out = out.withColumn(f"b{a}", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return out


def around(place: tuple[int, ...], extents: tuple[int, ...], blocks: tuple[int, ...], border: int) -> tuple[list[slice], list[slice]]:
    """(the block with its border, the block inside that) as slices."""
    outer = [slice(max(0, i * b - border), min(n, (i + 1) * b + border)) for i, b, n in zip(place, blocks, extents, strict=True)]
    inner = [slice(i * b - o.start, min(n, (i + 1) * b) - o.start) for i, b, n, o in zip(place, blocks, extents, outer, strict=True)]
    return outer, inner


def filled(group: pa.Table, value: str, extents: tuple[int, ...], blocks: tuple[int, ...], border: int) -> tuple[tuple[int, ...], np.ndarray, tuple[slice, ...], list[slice]]:
    place = tuple(group[f"b{a}"][0].as_py() for a in AXES)
    outer, inner = around(place, extents, blocks, border)
    values = np.zeros([s.stop - s.start for s in outer], np.int64)
    values[tuple(group[a].to_numpy() - s.start for a, s in zip(AXES, outer, strict=True))] = group[value].to_numpy()
    return place, values, tuple(inner), outer


def digest(lanes: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(lanes.astype("<u2")).tobytes()).hexdigest()


def encoding(extents: tuple[int, ...], blocks: tuple[int, ...], levels: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        place, lanes, inner, _ = filled(group, "lane", extents, blocks, tower.halo(levels))
        coefficients = tower.lift(lanes, levels)[inner]
        payload, bits, first = coding.pack(coding.zigzag(coefficients.ravel()))
        row = [group["sample"][0].as_py(), *place, coefficients.size, bits, first.astype("<i8").tobytes(), payload, digest(lanes[inner])]
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()), strict=True)], names=STORED.replace(" long", "").replace(" int", "").replace(" binary", "").replace(" string", "").split(", "))

    return run


def encode(cells: DataFrame, extents: tuple[int, ...], blocks: tuple[int, ...], levels: int) -> DataFrame:
    """The blocks (STORED) of (sample, t, y, x, lane)."""
    rows = bordered(cells, "lane", extents, blocks, tower.halo(levels))
    return rows.groupBy("sample", *(f"b{a}" for a in AXES)).applyInArrow(encoding(extents, blocks, levels), STORED)


def unpacking(extents: tuple[int, ...], blocks: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = tuple(row[f"b{a}"] for a in AXES)
                shape = [min(n, (i + 1) * b) - i * b for i, b, n in zip(place, blocks, extents, strict=True)]
                values = coding.unzigzag(coding.unpack(row["payload"], row["lanes"], np.frombuffer(row["firsts"], "<i8")))
                at = np.indices(shape).reshape(len(AXES), -1)
                cols = [pa.array(np.full(len(values), row["sample"])), *(pa.array(p + i * b) for p, i, b in zip(at, place, blocks, strict=True)), pa.array(values)]
                yield pa.RecordBatch.from_arrays(cols, names=["sample", *AXES, "coefficient"])

    return run


LANES = "sample long, bt int, by int, bx int, t long, y long, x long, lane long"


def lowering(extents: tuple[int, ...], blocks: tuple[int, ...], levels: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        place, values, inner, outer = filled(group, "coefficient", extents, blocks, tower.halo(levels))
        lanes = tower.lower(values, levels)[inner]
        at = np.indices(lanes.shape).reshape(len(AXES), -1)
        n = lanes.size
        cols = [pa.array(np.full(n, group["sample"][0].as_py())), *(pa.array(np.full(n, p, np.int32)) for p in place), *(pa.array(p + o.start + i.start) for p, o, i in zip(at, outer, inner, strict=True)), pa.array(lanes.ravel())]
        return pa.table(cols, names=["sample", "bt", "by", "bx", *AXES, "lane"])

    return run


def decode(stored: DataFrame, extents: tuple[int, ...], blocks: tuple[int, ...], levels: int) -> DataFrame:
    """(sample, bt, by, bx, t, y, x, lane): the lattice of stored blocks."""
    coefficients = stored.select("sample", "bt", "by", "bx", "lanes", "firsts", "payload").mapInArrow(unpacking(extents, blocks), "sample long, t long, y long, x long, coefficient long")
    key = ["sample", *(f"b{a}" for a in AXES)]
    # Blocks that aren't stored hold nothing but zeros.
    rows = bordered(coefficients, "coefficient", extents, blocks, tower.halo(levels)).join(stored.select(*key), key, "left_semi")
    return rows.groupBy(*key).applyInArrow(lowering(extents, blocks, levels), LANES)


def roots(digests: DataFrame) -> DataFrame:
    """(sample, root): the SHA-256 of a sample's block digests (sample, bt, by, bx, digest), in order."""
    ordered = F.sort_array(F.collect_list(F.struct("bt", "by", "bx", "digest")))  # one short row a block
    return digests.groupBy("sample").agg(F.sha2(F.concat_ws("", F.transform(ordered, lambda x: x["digest"])), 256).alias("root"))


def resealed(lattice: DataFrame) -> DataFrame:
    """(sample, bt, by, bx, digest, lanes, total) of decoded lanes."""

    def run(group: pa.Table) -> pa.Table:
        lanes = group.sort_by([(a, "ascending") for a in AXES])["lane"].to_numpy()
        cols = [group[c].slice(0, 1).combine_chunks() for c in ("sample", "bt", "by", "bx")]
        fits = bool(((lanes >= 0) & (lanes < 1 << 16)).all())
        return pa.table([*cols, pa.array([digest(lanes) if fits else "not lanes"]), pa.array([len(lanes)], pa.int64()), pa.array([int(lanes.sum())], pa.int64())], names=["sample", "bt", "by", "bx", "digest", "lanes", "total"])

    return lattice.groupBy("sample", "bt", "by", "bx").applyInArrow(run, "sample long, bt int, by int, bx int, digest string, lanes long, total long")


def prove(stored: DataFrame, kept: DataFrame, extents: tuple[int, ...], blocks: tuple[int, ...], levels: int) -> DataFrame:
    """(sample, lanes, total, proved): whether a sample's lanes, lowered from its codes, give the root (sample, root) kept for it."""
    again = resealed(decode(stored, extents, blocks, levels))
    counts = again.groupBy("sample").agg(F.sum("lanes").alias("lanes"), F.sum("total").alias("total"))
    found = counts.join(roots(again).withColumnRenamed("root", "found"), "sample")
    return found.join(kept, "sample", "full").select("sample", "lanes", "total", F.coalesce(F.col("found") == F.col("root"), F.lit(False)).alias("proved"))
