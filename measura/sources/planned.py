"""Arrays in chunks as a Spark data source whose reads are planned by byte range.

``spark.read.format("chunked_arrays").load(folder)`` gives the lattice rows (sample, t, z, y, x, lane) of the HDF5 files and
zarr arrays of version 3 in a folder.  While Spark plans, only their indexes are read: the chunk tree of an HDF5 file, a zarr
array's metadata, and the indexes at the ends of its shards.  Filters on the axes are taken over: chunks outside them aren't read,
and of those that reach across, the places outside are left out.  The ranges of what is left are dealt into tasks of about
``rangeBytes``; a task reads its ranges, unpacks them and yields Arrow batches of a frame at a time at most.

Options: path; dataset (of HDF5 files, ``/lattice``); rangeBytes (32 MiB).  Filters are taken over where
``spark.sql.python.filterPushdown.enabled`` is true; register() sets it.

Files are read through Arrow's file systems (local or mounted paths, hdfs, s3, gs), by executors as well as the driver.  Absent
chunks hold the fill value and give no rows.  Elements that aren't whole numbers of at most 16 bits fail the query.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from measura.sources import hdf5
from measura.sources.arrays import LATTICE, lanes

AXES = ("t", "z", "y", "x")
SUFFIXES = (".h5", ".hdf5", ".ims")
RANGE = 32 << 20
FAR = 1 << 62
ABSENT = (1 << 64) - 1
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def reader_of(file: Any) -> hdf5.Read:
    def read(at: int, size: int) -> bytes:
        file.seek(at)
        data = file.read(size)
        return data

    return read


@cache
def castagnoli() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0x82F63B78 if x & 1 else 0)
        out.append(x)
    return out


def crc32c(data: bytes) -> int:
    table, x = castagnoli(), 0xFFFFFFFF
    for b in data:
        x = table[(x ^ b) & 255] ^ x >> 8
    return x ^ 0xFFFFFFFF


@dataclass(frozen=True)
class Chunk:
    file: str
    corner: tuple[int, ...]
    at: int
    size: int
    mask: int = 0


@dataclass
class Hdf5Array:
    sample: str
    of: hdf5.Dataset

    @property
    def shape(self) -> tuple[int, ...]:
        return self.of.shape

    def decode(self, data: bytes, chunk: Chunk) -> np.ndarray:
        return hdf5.unpacked(self.of, data, chunk.mask)


@dataclass
class ZarrArray:
    sample: str
    shape: tuple[int, ...]
    kind: np.dtype
    chunks: tuple[int, ...]
    codec: str | None

    def decode(self, data: bytes, chunk: Chunk) -> np.ndarray:
        plain = gzip.decompress(data) if self.codec == "gzip" else zstandard.ZstdDecompressor().decompress(data, max_output_size=int(np.prod(self.chunks)) * self.kind.itemsize) if self.codec else data
        return np.frombuffer(plain, self.kind).reshape(self.chunks)


def bounds_of(shape: tuple[int, ...], asked: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last places of an array's own axes, which are the last of AXES."""
    return [(max(0, asked.get(a, (0, FAR))[0]), min(n - 1, asked.get(a, (0, FAR))[1])) for a, n in zip(AXES[len(AXES) - len(shape) :], shape, strict=True)]


def hdf5_plan(store: fs.FileSystem, path: str, name: str, asked: dict[str, tuple[int, int]]) -> tuple[Hdf5Array, list[Chunk]]:
    with store.open_input_file(path) as file:
        read = reader_of(file)
        of = hdf5.dataset(read, name)
        return Hdf5Array(path.rsplit("/", 1)[-1], of), [Chunk(path, *found) for found in hdf5.chunk_ranges(read, of, bounds_of(of.shape, asked))]


def packing(codecs: list[dict]) -> tuple[str, str | None]:
    """(byte order, codec) of a chain of bytes and at most one of gzip and zstd."""
    first, *packed = codecs
    if first["name"] != "bytes" or len(packed) > 1 or any(c["name"] not in ("gzip", "zstd") for c in packed):
        raise ValueError("only bytes, packed by gzip or zstd or not at all, are read")
    return (">" if first.get("configuration", {}).get("endian") == "big" else "<"), (packed[0]["name"] if packed else None)


def zarr_plan(store: fs.FileSystem, path: str, asked: dict[str, tuple[int, int]]) -> tuple[ZarrArray, list[Chunk]]:
    with store.open_input_file(f"{path}/zarr.json") as file:
        meta = json.loads(file.read())
    if meta["node_type"] != "array" or meta["chunk_grid"]["name"] != "regular":
        raise ValueError("only arrays in a regular grid are read")
    shape, outer = tuple(meta["shape"]), tuple(meta["chunk_grid"]["configuration"]["chunk_shape"])
    sharded = meta["codecs"][0]["name"] == "sharding_indexed"
    inner = meta["codecs"][0]["configuration"] if sharded else {"chunk_shape": outer, "codecs": meta["codecs"]}
    order, codec = packing(inner["codecs"])
    chunks = tuple(inner["chunk_shape"])
    array = ZarrArray(path.rsplit("/", 1)[-1], shape, np.dtype(meta["data_type"]).newbyteorder(order), chunks, codec)
    keys = meta["chunk_key_encoding"]
    plain = keys["name"] == "v2"
    separator, bounds, out = keys.get("configuration", {}).get("separator", "." if plain else "/"), bounds_of(shape, asked), []
    grid = [range(lo // c, hi // c + 1) for (lo, hi), c in zip(bounds, outer, strict=True)]
    for place in np.ndindex(*(len(g) for g in grid)) if all(map(len, grid)) else ():
        at = [g[i] for g, i in zip(grid, place, strict=True)]
        file = f"{path}/" + separator.join([*([] if plain else ["c"]), *map(str, at)])
        info = store.get_file_info(file)
        if info.type != fs.FileType.File:
            continue
        corner = tuple(i * c for i, c in zip(at, outer, strict=True))
        if sharded:
            out += [c for c in shard_chunks(store, file, info.size, corner, outer, inner) if hdf5.inside(c.corner, chunks, bounds)]
        else:
            out.append(Chunk(file, corner, 0, info.size))
    return array, out


def shard_chunks(store: fs.FileSystem, path: str, size: int, corner: tuple[int, ...], outer: tuple[int, ...], inner: dict) -> Iterator[Chunk]:
    """The chunks of a shard, from the index at its end or beginning alone."""
    names = [c["name"] for c in inner["index_codecs"]]
    if names not in (["bytes"], ["bytes", "crc32c"]):
        raise ValueError(f"shard indexes in {names} aren't read")
    counts = [o // c for o, c in zip(outer, inner["chunk_shape"], strict=True)]
    length = 16 * int(np.prod(counts)) + 4 * ("crc32c" in names)
    with store.open_input_file(path) as file:
        data = reader_of(file)(size - length if inner.get("index_location", "end") == "end" else 0, length)
    if "crc32c" in names and crc32c(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError(f"the index of {path} doesn't match its checksum")
    entries = np.frombuffer(data[: 16 * int(np.prod(counts))], "<u8").reshape(*counts, 2)
    for place in np.ndindex(*counts):
        at, n = (int(v) for v in entries[place])
        if at != ABSENT:
            yield Chunk(path, tuple(a + i * c for a, i, c in zip(corner, place, inner["chunk_shape"], strict=True)), at, n)


def plans(path: str, name: str, asked: dict[str, tuple[int, int]]) -> Iterator[tuple[Hdf5Array | ZarrArray, list[Chunk]]]:
    """Every array in a folder, by name, with the chunks that meet the bounds."""
    store, root = opened(path)
    infos = [store.get_file_info(root)]
    if infos[0].type == fs.FileType.Directory and store.get_file_info(f"{root}/zarr.json").type != fs.FileType.File:
        infos = sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path)
    for info in infos:
        if info.type == fs.FileType.Directory:
            if store.get_file_info(f"{info.path}/zarr.json").type == fs.FileType.File:
                yield zarr_plan(store, info.path, asked)
        elif info.path.endswith(SUFFIXES):
            yield hdf5_plan(store, info.path, name, asked)


class Ranges(InputPartition):
    def __init__(self, array: Hdf5Array | ZarrArray, chunks: list[Chunk]) -> None:
        self.array, self.chunks = array, chunks


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.name = options["path"], options.get("dataset", "/lattice")
        self.most = int(options.get("rangeBytes", RANGE))
        self.asked: dict[str, tuple[int, int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802, the interface's name
        for f in filters:
            axis = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if axis not in AXES or not isinstance(f.value, int):
                yield f
                continue
            lo, hi = self.asked.get(axis, (0, FAR))
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                lo = max(lo, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                hi = min(hi, f.value - isinstance(f, LessThan))
            self.asked[axis] = (lo, hi)

    def partitions(self) -> list[Ranges]:
        out = []
        # Axes that an array lacks hold the place 0 alone.
        for array, chunks in plans(self.path, self.name, self.asked):
            lacks = AXES[: len(AXES) - len(array.shape)]
            if any(lo > hi or (a in lacks and lo > 0) or hi < 0 for a, (lo, hi) in self.asked.items()):
                continue
            part, total = [], 0
            for chunk in sorted(chunks, key=lambda c: (c.file, c.at)):
                if part and total + chunk.size > self.most:
                    out.append(Ranges(array, part))
                    part, total = [], 0
                part.append(chunk)
                total += chunk.size
            if part:
                out.append(Ranges(array, part))
        return out or [Ranges(None, [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, name, file = opened(self.path)[0], None, None
        for chunk in partition.chunks:
            if chunk.file != name:
                if file is not None:
                    file.close()
                name, file = chunk.file, store.open_input_file(chunk.file)
            yield from self.rows(partition.array, chunk, reader_of(file)(chunk.at, chunk.size))

    def rows(self, array: Hdf5Array | ZarrArray, chunk: Chunk, data: bytes) -> Iterator[pa.RecordBatch]:
        block = array.decode(data, chunk)
        bounds = bounds_of(array.shape, self.asked)
        begin = [max(a, lo) for a, (lo, _) in zip(chunk.corner, bounds, strict=True)]
        end = [min(a + n, hi + 1) for a, n, (_, hi) in zip(chunk.corner, block.shape, bounds, strict=True)]
        block = block[tuple(slice(b - a, max(b, e) - a) for a, b, e in zip(chunk.corner, begin, end, strict=True))]
        values = lanes(np.ascontiguousarray(block))
        first = [0] * (len(AXES) - len(begin)) + begin
        for t, volume in enumerate(values):
            if volume.size:
                z, y, x = (i.ravel() for i in np.indices(volume.shape, np.int32))
                places = (np.full(volume.size, t + first[0], np.int32), z + np.int32(first[1]), y + np.int32(first[2]), x + np.int32(first[3]))
                yield pa.RecordBatch.from_arrays([pa.array([array.sample] * volume.size), *map(pa.array, places), pa.array(volume.ravel().astype(np.int32))], names=["sample", *AXES, "lane"])


class ChunkedArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunked_arrays"

    def schema(self) -> str:
        return LATTICE

    def reader(self, schema: Any) -> ChunkReader:
        return ChunkReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets it take filters over."""
    spark.dataSource.register(ChunkedArrays)
    spark.conf.set(PUSHDOWN, "true")


def arrays(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("chunked_arrays").options(**options).load(path)


def chunk_index(spark: SparkSession, path: str, name: str = "/lattice") -> DataFrame:
    """(sample, t, z, y, x, at, bytes): the first place, address and packed size of every chunk of the HDF5 files in a folder.

    The files' indexes are read by the tasks, each by the ranges that it needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch["path"].to_pylist():
                store, root = opened(where)
                array, chunks = hdf5_plan(store, root, name, {})
                corners = np.array([[0] * (len(AXES) - len(c.corner)) + list(c.corner) for c in chunks], np.int64).reshape(-1, len(AXES))
                cols = [pa.array([array.sample] * len(chunks)), *(pa.array(corners[:, k]) for k in range(len(AXES))), pa.array([c.at for c in chunks], pa.int64()), pa.array([c.size for c in chunks], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["sample", *AXES, "at", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{h5,hdf5,ims}").load(path).select("path")
    return files.mapInArrow(run, "sample string, t long, z long, y long, x long, at long, bytes long")


def zarr_shards(a: np.ndarray, shard: tuple[int, ...], chunk: tuple[int, ...]) -> dict[str, bytes]:
    """Files of a version 3 array in shards of gzip chunks; chunks of zeros alone are left out."""
    inner = {
        "chunk_shape": list(chunk), "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}],
        "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end",
    }
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": "uint16", "fill_value": 0, "attributes": {},
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shard)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": [{"name": "sharding_indexed", "configuration": inner}],
    }
    out = {"zarr.json": json.dumps(meta).encode()}
    full = np.pad(a, [(0, -n % s) for n, s in zip(a.shape, shard, strict=True)]).astype("<u2")
    counts = [s // c for s, c in zip(shard, chunk, strict=True)]
    for place in np.ndindex(*(n // s for n, s in zip(full.shape, shard, strict=True))):
        body, entries = b"", np.full((*counts, 2), ABSENT, "<u8")
        for inside in np.ndindex(*counts):
            block = full[tuple(slice(p * s + i * c, p * s + (i + 1) * c) for p, s, i, c in zip(place, shard, inside, chunk, strict=True))]
            if block.any():
                data = gzip.compress(block.tobytes(), 1)
                entries[inside] = len(body), len(data)
                body += data
        index = entries.tobytes()
        out["/".join(["c", *map(str, place)])] = body + index + struct.pack("<I", crc32c(index))
    return out
