"""Planned reads: indexes, ranges and filters of arrays in chunks."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from measura.sources import hdf5, planned

SHAPE, CHUNKS = (20, 3, 33, 18), (3, 1, 8, 5)


@pytest.fixture(scope="module")
def array():
    return np.random.default_rng(4).integers(0, 60_000, SHAPE).astype(np.uint16)


def source(data):
    reads = []

    def read(at, size):
        reads.append((at, size))
        return data[at : at + size]

    return read, reads


def whole(read, of, bounds):
    out, found = np.zeros(of.shape, of.kind), list(hdf5.chunk_ranges(read, of, bounds))
    for corner, at, size, mask in found:
        block = hdf5.unpacked(of, read(at, size), mask)
        place = tuple(slice(c, min(c + n, s)) for c, n, s in zip(corner, block.shape, of.shape, strict=True))
        out[place] = block[tuple(slice(0, p.stop - p.start) for p in place)]
    return out, found


def test_hdf5_round_trip_over_a_tree_of_several_levels(array):
    read, _ = source(hdf5.write(array, CHUNKS))
    of = hdf5.dataset(read, "/lattice")
    assert (of.shape, of.chunks, of.kind) == (SHAPE, CHUNKS, np.dtype("<u2"))
    back, found = whole(read, of, [(0, n - 1) for n in SHAPE])
    assert (back == array).all() and len(found) == 7 * 3 * 5 * 4


def test_only_the_parts_of_the_index_that_are_asked_for_are_read(array):
    data = hdf5.write(array, CHUNKS)
    read, reads = source(data)
    of = hdf5.dataset(read, "lattice")
    before = len(reads)
    found = list(hdf5.chunk_ranges(read, of, [(4, 5), (1, 1), (0, 7), (17, 17)]))
    assert [c for c, *_ in found] == [(3, 1, 0, 15)]
    some = len(reads) - before
    list(hdf5.chunk_ranges(read, of, [(0, n - 1) for n in SHAPE]))
    assert some < (len(reads) - before - some) / 2


def test_what_is_not_read_is_named(array):
    data = hdf5.write(array[:2], CHUNKS)
    for bad, text in ((b"x" * 200, "not an HDF5 file"), (data[:8] + b"\2" + data[9:], "superblock version 2")):
        with pytest.raises(ValueError, match=text):
            hdf5.dataset(source(bad)[0], "/lattice")
    with pytest.raises(ValueError, match="no object other"):
        hdf5.dataset(source(data)[0], "/other")
    with pytest.raises(ValueError, match="no dataset"):
        hdf5.dataset(source(data)[0], "/")


def test_contiguous_data_is_planned_by_slabs(array):
    part = array[:4, 0]
    data = bytearray(hdf5.write(part, (4, 33, 18)))
    read, _ = source(bytes(data))
    at = len(data)
    old = struct.pack("<BBB", 3, 2, 4)
    where = data.index(old)
    data[where : where + 18] = struct.pack("<BBQQ", 3, 1, at, part.nbytes)
    read, _ = source(bytes(data) + part.astype("<u2").tobytes())
    of = hdf5.dataset(read, "/lattice")
    back, found = whole(read, of, [(1, 2), (0, 32), (0, 17)])
    assert len(found) == 2 and (back[1:3] == part[1:3]).all() and not back[0].any()


def test_filters_left_out_of_a_chunk(array):
    of = hdf5.Dataset((4,), np.dtype("<u2"), (4,), 0, True, [(hdf5.SHUFFLE, [2]), (hdf5.DEFLATE, [1])])
    assert hdf5.unpacked(of, np.array([1, 2, 3, 256], "<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 2).tolist() == [1, 2, 3, 256]
    assert hdf5.unpacked(of, np.array([1, 2, 3, 256], "<u2").tobytes(), 3).tolist() == [1, 2, 3, 256]


def reader(path, **options):
    return planned.ChunkReader({"path": str(path), **options})


def put(folder, files):
    for name, data in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)


@pytest.mark.parametrize("kind", ["hdf5", "shards"])
def test_filters_choose_the_chunks(spark, tmp_path, array, kind):
    put(tmp_path, {"a.h5": hdf5.write(array, CHUNKS)} if kind == "hdf5" else {f"a.h5/{k}": v for k, v in planned.zarr_shards(array, (6, 1, 16, 10), CHUNKS).items()})
    r = reader(tmp_path, rangeBytes="1")
    assert sum(len(p.chunks) for p in r.partitions()) == 7 * 3 * 5 * 4
    left = list(r.pushFilters([GreaterThan(("t",), 3), LessThanOrEqual(("t",), 5), EqualTo(("z",), 1), EqualTo(("lane",), 7)]))
    assert left == [EqualTo(("lane",), 7)]
    assert sum(len(p.chunks) for p in r.partitions()) == 1 * 1 * 5 * 4 and len(r.partitions()) == 20
    df = planned.arrays(spark, str(tmp_path)).where("t > 3 AND t <= 5 AND z = 1 AND lane > 30000")
    got = {(x["t"], x["z"], x["y"], x["x"]): x["lane"] for x in df.collect()}
    assert got == {(t, z, y, x): int(v) for (t, z, y, x), v in np.ndenumerate(array) if 3 < t <= 5 and z == 1 and v > 30_000}
    assert df.select("sample").distinct().collect()[0]["sample"] == "a.h5"


def test_absent_chunks_checksums_and_empty_folders(spark, tmp_path, array):
    sparse = np.zeros((6, 1, 16, 10), np.uint16)
    sparse[5, 0, 3, 3] = 9
    files = planned.zarr_shards(sparse, (6, 1, 16, 10), CHUNKS)
    put(tmp_path / "one", {f"a/{k}": v for k, v in files.items()})
    assert sum(len(p.chunks) for p in reader(tmp_path / "one").partitions()) == 1
    assert planned.arrays(spark, str(tmp_path / "one")).where("lane > 0").count() == 1
    shard = next(k for k in files if k != "zarr.json")
    put(tmp_path / "two", {"a/zarr.json": files["zarr.json"], f"a/{shard}": files[shard][:-1] + bytes([files[shard][-1] ^ 1])})
    with pytest.raises(ValueError, match="checksum"):
        reader(tmp_path / "two").partitions()
    (tmp_path / "three").mkdir()
    assert planned.arrays(spark, str(tmp_path / "three")).count() == 0
    assert planned.crc32c(b"123456789") == 0xE3069283
