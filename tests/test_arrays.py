"""Array files written with numpy or by hand, read back as lattice rows."""

from __future__ import annotations

import gzip
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from measura.sources import arrays, writers

RNG = np.random.default_rng(0)


def nifti(a: np.ndarray, code: int) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    dims = a.shape[::-1]
    struct.pack_into("<8h", head, 40, a.ndim, *dims, *[1] * (7 - a.ndim))
    struct.pack_into("<hh", head, 70, code, 8 * a.dtype.itemsize)
    struct.pack_into("<f", head, 108, 352.0)
    return bytes(head) + a.tobytes()


def files(folder) -> dict[str, np.ndarray]:
    wanted = {"a.npy": RNG.integers(0, 65536, (2, 3, 4, 5), dtype=np.uint16), "b.nrrd": RNG.integers(-99, 99, (3, 4), dtype=np.int16), "c.stack": RNG.integers(0, 65536, (2, 1, 3, 2), dtype=np.uint16), "d.nii.gz": RNG.integers(0, 255, (2, 3, 4), dtype=np.uint8)}
    np.save(folder / "a.npy", wanted["a.npy"])
    (folder / "b.nrrd").write_bytes(b"NRRD0004\ntype: int16\ndimension: 2\nsizes: 4 3\nendian: little\nencoding: gzip\n\n" + gzip.compress(wanted["b.nrrd"].tobytes()))
    (folder / "c.stack").write_bytes(struct.pack("<4I", 2, 1, 3, 2) + wanted["c.stack"].tobytes())
    (folder / "d.nii.gz").write_bytes(gzip.compress(nifti(wanted["d.nii.gz"], 2)))
    return wanted


def test_lattice_rows(spark, tmp_path):
    wanted = files(tmp_path)
    rows = arrays.lattice(spark, str(tmp_path)).collect()
    for name, a in wanted.items():
        got = {(r["t"], r["z"], r["y"], r["x"]): r["lane"] for r in rows if r["sample"] == name}
        full = a.reshape((1,) * (4 - a.ndim) + a.shape).astype(int) + (32768 if a.dtype.kind == "i" else 0)
        assert got == {k: int(v) for k, v in np.ndenumerate(full)}
    assert {r["sample"] for r in arrays.samples(spark, str(tmp_path)).collect()} == set(wanted)


def test_floats_fail(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.zeros(3, np.float32))
    with pytest.raises(Exception, match="whole numbers"):
        arrays.lattice(spark, str(tmp_path)).collect()


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one", b"1" * 99)
        z.writestr("two/three", b"")
    got = {r["member"]: bytes(r["content"]) for r in arrays.zip_members(spark, str(tmp_path)).collect()}
    assert got == {"one": b"1" * 99, "two/three": b""}


@pytest.mark.parametrize("codec", ["deflate", "zlib", "gzip", "zstd", "lz4", "snappy"])
def test_codecs_round_trip(spark, codec):
    df = spark.createDataFrame([(bytearray(b"abc" * 500),), (bytearray(b""),), (None,)], "b binary")
    rows = df.withColumn("p", arrays.encoded_as("b", codec)).withColumn("u", arrays.decoded("p", codec)).collect()
    assert all(r["b"] == r["u"] for r in rows)


def test_seal_changes_with_one_value(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    one = {r["g"]: r["root"] for r in arrays.seal(df, ["g"], ["k"], "v").collect()}
    two = {r["g"]: r["root"] for r in arrays.seal(df.withColumn("v", F.when(F.col("k") == 4001, 0).otherwise(F.col("v"))), ["g"], ["k"], "v").collect()}
    assert one[0] == two[0] and one[1] != two[1]


def tiff(pages: np.ndarray, deflate: bool) -> bytes:
    body, out, offsets = b"", bytearray(b"II*\0\0\0\0\0"), []
    for page in pages:
        strips = [zlib.compress(r.tobytes()) if deflate else r.tobytes() for r in np.array_split(page, 2)]
        places = []
        for s in strips:
            places.append(len(out))
            out += s
        table = len(out)
        out += struct.pack("<4I", *places, *map(len, strips))
        entries = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, 1, 8 * page.dtype.itemsize), (259, 3, 1, 8 if deflate else 1), (273, 4, 2, table), (279, 4, 2, table + 8), (339, 3, 1, 2 if page.dtype.kind == "i" else 1)]
        offsets.append(len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"
    struct.pack_into("<I", out, 4, offsets[0])
    for a, b in zip(offsets, offsets[1:], strict=False):
        struct.pack_into("<I", out, a + 2 + 7 * 12, b)
    return bytes(out) + body


def dicom(a: np.ndarray) -> bytes:
    short = lambda g, e, v: struct.pack("<HH2sHH", g, e, b"US", 2, v)
    frames = str(a.shape[0]).encode().ljust(2)
    return b"\0" * 128 + b"DICM" + struct.pack("<HH2sH", 0x28, 8, b"IS", 2) + frames + short(0x28, 0x10, a.shape[1]) + short(0x28, 0x11, a.shape[2]) + short(0x28, 0x100, 16) + short(0x28, 0x103, 0) + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, a.nbytes) + a.tobytes()


def as_map(rows, sample):
    return {(r["t"], r["z"], r["y"], r["x"]): r["lane"] for r in rows if r["sample"] == sample}


def expected(a):
    return {k: int(v) + (32768 if a.dtype.kind == "i" else 0) for k, v in np.ndenumerate(a.reshape((1,) * (4 - a.ndim) + a.shape))}


def test_tiff_and_dicom(spark, tmp_path):
    plain, packed, pixels = RNG.integers(0, 65536, (3, 4, 5), dtype=np.uint16), RNG.integers(-9, 9, (2, 6, 3), dtype=np.int8), RNG.integers(0, 4096, (2, 3, 4), dtype=np.uint16)
    (tmp_path / "a.tif").write_bytes(tiff(plain, False))
    (tmp_path / "b.tiff").write_bytes(tiff(packed, True))
    (tmp_path / "c.dcm").write_bytes(dicom(pixels))
    rows = arrays.lattice(spark, str(tmp_path)).collect()
    assert as_map(rows, "a.tif") == expected(plain)
    assert as_map(rows, "b.tiff") == expected(packed)
    assert as_map(rows, "c.dcm") == expected(pixels)


@pytest.mark.parametrize("codec", [None, "zlib", "gzip", "zstd"])
def test_zarr(spark, tmp_path, codec):
    a = RNG.integers(0, 65536, (5, 7), dtype=np.uint16)
    pack = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[codec]
    (tmp_path / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 7], "chunks": [3, 4], "dtype": "<u2", "order": "C", "fill_value": 0, "filters": None, "compressor": codec and {"id": codec}}))
    padded = np.zeros((6, 8), np.uint16)
    padded[:5, :7] = a
    for i in range(2):
        for j in range(2):
            (tmp_path / f"{i}.{j}").write_bytes(pack(padded[3 * i : 3 * i + 3, 4 * j : 4 * j + 4].tobytes()))
    assert as_map(arrays.zarr(spark, str(tmp_path)).collect(), tmp_path.name) == expected(a)


@pytest.mark.parametrize(("keys", "separator", "codec", "endian"), [("default", "/", "gzip", "little"), ("default", ".", None, "big"), ("v2", ".", "zstd", "little"), ("v2", "/", "gzip", "big")])
def test_zarr_3(spark, tmp_path, keys, separator, codec, endian):
    a = RNG.integers(0, 65536, (5, 7), dtype=np.uint16)
    pack = {None: bytes, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[codec]
    codecs = [{"name": "bytes", "configuration": {"endian": endian}}, *([{"name": codec, "configuration": {}}] if codec else [])]
    grid = {"name": "regular", "configuration": {"chunk_shape": [3, 4]}}
    meta = {"zarr_format": 3, "node_type": "array", "shape": [5, 7], "data_type": "uint16", "chunk_grid": grid, "chunk_key_encoding": {"name": keys, "configuration": {"separator": separator}}, "fill_value": 0, "codecs": codecs}
    (tmp_path / "zarr.json").write_text(json.dumps(meta))
    padded = np.zeros((6, 8), ">u2" if endian == "big" else "<u2")
    padded[:5, :7] = a
    for i in range(2):
        for j in range(2):
            file = tmp_path / separator.join([*(["c"] if keys == "default" else []), str(i), str(j)])
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(pack(padded[3 * i : 3 * i + 3, 4 * j : 4 * j + 4].tobytes()))
    assert as_map(arrays.zarr(spark, str(tmp_path)).collect(), tmp_path.name) == expected(a)


def test_zarr_3_in_shards_fails(spark, tmp_path):
    meta = {"node_type": "array", "chunk_grid": {"name": "regular"}, "codecs": [{"name": "sharding_indexed", "configuration": {}}]}
    (tmp_path / "zarr.json").write_text(json.dumps(meta))
    with pytest.raises(ValueError, match="regular grid"):
        arrays.zarr(spark, str(tmp_path))


@pytest.mark.parametrize("most", [2, 40, 256])
@pytest.mark.parametrize("n", [0, 1, 600, 30_000])
def test_lzw_round_trip(n, most):
    data = np.random.default_rng(n).integers(0, most, n).astype(np.uint8).tobytes()
    assert arrays.lzw(writers.lzw(data)) == data


@pytest.mark.parametrize("shape", [(2, 16, 16), (3, 20, 37), (1, 5, 5)])
def test_tiles_with_differences(shape):
    a = np.random.default_rng(1).integers(0, 60_000, shape).astype(np.uint16)
    assert (arrays.read_tiff(writers.tiled_tiff(a))[""] == a).all()


def test_a_tiff_without_pages_has_no_frames():
    assert arrays.read_tiff(b"II*\0\0\0\0\0")[""].shape == (0, 0, 0)
