"""Array files from arrays of 16-bit lanes: the inverse of measura.sources.arrays, for files that one task holds."""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file into any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def npz(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, lanes=a)
    return out.getvalue()


def stack(a: np.ndarray) -> bytes:
    shape = (1,) * (4 - a.ndim) + a.shape
    return struct.pack("<4I", *shape) + a.astype("<u2").tobytes()


def nrrd(a: np.ndarray) -> bytes:
    sizes = " ".join(map(str, a.shape[::-1]))
    return f"NRRD0004\ntype: uint16\ndimension: {a.ndim}\nsizes: {sizes}\nendian: little\nencoding: gzip\n\n".encode() + gzip.compress(a.astype("<u2").tobytes())


def nifti(a: np.ndarray) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, a.ndim, *a.shape[::-1], *[1] * (7 - a.ndim))
    struct.pack_into("<hh", head, 70, 512, 16)  # the format's code of unsigned 16-bit samples
    struct.pack_into("<f", head, 108, 352.0)
    return gzip.compress(bytes(head) + a.astype("<u2").tobytes())


def tiff(a: np.ndarray) -> bytes:
    """One deflated strip a page; every page's directory follows its strip."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in a:
        strip, at = zlib.compress(page.astype("<u2").tobytes()), len(out)
        out += strip + b"\0" * (len(strip) % 2)
        struct.pack_into("<I", out, link, len(out))
        entries = [(256, page.shape[1]), (257, page.shape[0]), (258, 16), (259, 8), (273, at), (279, len(strip)), (339, 1)]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: a table of at most 4,093 entries, then afresh."""
    out, held, width, table = 0, 0, 9, {bytes([k]): k for k in range(256)}
    codes = [(256, 9)]
    size, last = 258, b""
    for byte in data:
        more = last + bytes([byte])
        if more in table:
            last = more
            continue
        codes.append((table[last], width))
        table[more] = size
        size += 1
        width = 9 + (size > 511) + (size > 1023) + (size > 2047)
        if size > 4093:
            codes.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        last = bytes([byte])
    if last:
        codes.append((table[last], width))
        size += 1
        width = 9 + (size > 511) + (size > 1023) + (size > 2047)
    for code, bits in [*codes, (257, width)]:
        out, held = out << bits | code, held + bits
    return (out << -held % 8).to_bytes((held + 7) // 8, "big")


def tiled_tiff(a: np.ndarray, side: int = 16) -> bytes:
    """Pages in square tiles, as horizontal differences in LZW."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in a:
        full = np.pad(page, [(0, -n % side) for n in page.shape]).astype("<u2")
        at, sizes = [], []
        for y in range(0, full.shape[0], side):
            for x in range(0, full.shape[1], side):
                tile = full[y : y + side, x : x + side]
                data = lzw(np.diff(tile, axis=1, prepend=tile.dtype.type(0)).astype("<u2").tobytes())
                at.append(len(out))
                sizes.append(len(data))
                out += data + b"\0" * (len(data) % 2)
        lists = []
        for values in (at, sizes):
            lists.append(len(out) if len(values) > 1 else values[0])
            out += struct.pack(f"<{len(values)}I", *values) if len(values) > 1 else b""
        struct.pack_into("<I", out, link, len(out))
        entries = [(256, 1, page.shape[1]), (257, 1, page.shape[0]), (258, 1, 16), (259, 1, 5), (317, 1, 2), (322, 1, side), (323, 1, side), (324, len(at), lists[0]), (325, len(sizes), lists[1]), (339, 1, 1)]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, 4, n, value) for tag, n, value in entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def dicom(a: np.ndarray) -> bytes:
    text, short = str(a.shape[0]).encode(), lambda e, v: struct.pack("<HH2sHH", 0x28, e, b"US", 2, v)
    text += b" " * (len(text) % 2)
    body = a.astype("<u2").tobytes()
    frames = struct.pack("<HH2sH", 0x28, 8, b"IS", len(text)) + text
    return b"\0" * 128 + b"DICM" + frames + short(0x10, a.shape[1]) + short(0x11, a.shape[2]) + short(0x100, 16) + short(0x103, 0) + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, len(body)) + body


def zipped(a: np.ndarray) -> bytes:
    """An archive with one raw member for each frame."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for t, frame in enumerate(a):
            z.writestr(f"frames/{t}", frame.astype("<u2").tobytes())
    return out.getvalue()


def zarr(a: np.ndarray, chunk: int) -> dict[str, bytes]:
    """Files of a version 2 array in cubes of ``chunk``, packed by zlib."""
    meta = {"zarr_format": 2, "shape": a.shape, "chunks": [chunk] * a.ndim, "dtype": "<u2", "order": "C", "fill_value": 0, "filters": None, "compressor": {"id": "zlib", "level": 1}}
    return {".zarray": json.dumps(meta).encode()} | {".".join(map(str, corner)): zlib.compress(block.tobytes()) for corner, block in cubes(a, chunk)}


def zarr_3(a: np.ndarray, chunk: int) -> dict[str, bytes]:
    """Files of a version 3 array in cubes of ``chunk``, packed by gzip."""
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": "uint16", "fill_value": 0, "attributes": {},
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [chunk] * a.ndim}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}],
    }
    return {"zarr.json": json.dumps(meta).encode()} | {"/".join(["c", *map(str, corner)]): gzip.compress(block.tobytes()) for corner, block in cubes(a, chunk)}


def cubes(a: np.ndarray, chunk: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Places and contents of an array's chunks, those at its ends filled up with zeros."""
    padded = np.pad(a, [(0, -n % chunk) for n in a.shape]).astype("<u2")
    for corner in np.ndindex(*(n // chunk for n in padded.shape)):
        yield corner, padded[tuple(slice(i * chunk, (i + 1) * chunk) for i in corner)]


WRITERS = {"npy": npy, "npz": npz, "stack": stack, "nrrd": nrrd, "nii.gz": nifti, "tif": tiff, "tiled.tif": tiled_tiff, "dcm": dicom, "zip": zipped}
