"""Array files (npy, npz members, nrrd, nifti, tiff, dicom, zarr, stacks of uint16 frames) as lattice rows, and byte codecs.

Files are read with Spark's binaryFile source, so they can be in any store that Spark reads, and decoded on the
executors, one file a row.  A lattice row is (sample, t, z, y, x, lane): the last axes of the array are x, y, z, t from
the fastest; missing axes are 0.  Signed samples are shifted by 2^15, as lanes are unsigned 16-bit; other element
types than 8- and 16-bit whole numbers fail the query.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LATTICE = "sample string, t int, z int, y int, x int, lane int"
OFFSET = 1 << 15


def lanes(array: np.ndarray) -> np.ndarray:
    """An array of up to four axes as unsigned lanes over t, z, y, x."""
    if array.dtype.kind not in "iu" or array.dtype.itemsize > 2:
        raise ValueError(f"elements of type {array.dtype} are not 8- or 16-bit whole numbers")
    if array.ndim > 4:
        raise ValueError(f"{array.ndim} axes; at most four can be read")
    wide = array.astype(np.int64) + (OFFSET if array.dtype.kind == "i" else 0)
    return wide.reshape((1,) * (4 - array.ndim) + array.shape)


def read_npy(data: bytes) -> dict[str, np.ndarray]:
    return {"": np.load(io.BytesIO(data), allow_pickle=False)}


def read_npz(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {f"/{n}": z[n] for n in z.files}


def read_stack(data: bytes) -> dict[str, np.ndarray]:
    """Four little-endian 32-bit extents, t z y x, and the samples after them."""
    shape = struct.unpack_from("<4I", data)
    return {"": np.frombuffer(data, "<u2", int(np.prod(shape)), 16).reshape(shape)}


NRRD_TYPES = {"uint8": "u1", "uchar": "u1", "unsigned char": "u1", "int8": "i1", "signed char": "i1", "uint16": "u2", "ushort": "u2", "unsigned short": "u2", "int16": "i2", "short": "i2"}


def read_nrrd(data: bytes) -> dict[str, np.ndarray]:
    head, _, body = data.partition(b"\n\n")
    fields = {}
    for line in head.decode("ascii").splitlines()[1:]:
        name, mark, value = line.partition(":")
        if mark and not line.startswith("#") and not value.startswith("="):
            fields[name.strip().lower()] = value.strip()
    if fields["type"] not in NRRD_TYPES:
        raise ValueError(f"elements of type {fields['type']} are not 8- or 16-bit whole numbers")
    if fields["encoding"] in ("gzip", "gz"):
        body = gzip.decompress(body)
    elif fields["encoding"] != "raw":
        raise ValueError(f"encoding {fields['encoding']} is not raw or gzip")
    order = ">" if fields.get("endian") == "big" else "<"
    shape = tuple(map(int, fields["sizes"].split()))[::-1]
    return {"": np.frombuffer(body, order + NRRD_TYPES[fields["type"]], int(np.prod(shape))).reshape(shape)}


NIFTI_TYPES = {2: "u1", 4: "i2", 256: "i1", 512: "u2"}


def read_nifti(data: bytes) -> dict[str, np.ndarray]:
    """NIfTI-1, plain or gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    dims = struct.unpack_from(order + "8h", data, 40)
    kind, start = struct.unpack_from(order + "h", data, 70)[0], int(struct.unpack_from(order + "f", data, 108)[0])
    if kind not in NIFTI_TYPES:
        raise ValueError(f"datatype {kind} is not an 8- or 16-bit whole number")
    shape = dims[1 : dims[0] + 1][::-1]
    return {"": np.frombuffer(data, order + NIFTI_TYPES[kind], int(np.prod(shape)), start).reshape(shape)}


TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 8: 2, 9: 4, 16: 8}
TIFF_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}


def lzw(data: bytes) -> bytes:
    """Bytes of TIFF's LZW: codes of 9 to 12 bits from the highest bit down, a width ending one code early."""
    clear, end = 256, 257
    out, table, last = [], [], b""
    value = held = 0
    width = 9
    for byte in data:
        value, held = value << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, value = value >> held, value & ((1 << held) - 1)
        if code == end:
            break
        if code == clear:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if code > len(table) or not table:
            raise ValueError("an LZW code before it is known")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def tiff_block(data: bytes, packed: int, shape: tuple[int, int], kind: str, predictor: int) -> np.ndarray:
    """A strip or tile of a page; rows that a strip lacks are left out."""
    plain = data if packed == 1 else lzw(data) if packed == 5 else zlib.decompress(data)
    values = np.frombuffer(plain, kind)
    values = values[: len(values) // shape[1] * shape[1]].reshape(-1, shape[1])[: shape[0]]
    # Differences to the pixel before, modulo the sample's width.
    return np.add.accumulate(values, axis=1, dtype=values.dtype) if predictor == 2 else values


def tiff_page(data: bytes, tags: dict[int, tuple], kind: str) -> np.ndarray:
    height, width, packed, predictor = tags[257][0], tags[256][0], tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    page = np.zeros((height, width), kind)
    if 322 in tags:
        across, down = tags[322][0], tags[323][0]
        for k, (at, n) in enumerate(zip(tags[324], tags[325], strict=True)):
            y, x = (i * side for i, side in zip(divmod(k, -(-width // across)), (down, across), strict=True))
            page[y : y + down, x : x + across] = tiff_block(data[at : at + n], packed, (down, across), kind, predictor)[: height - y, : width - x]
        return page
    rows, y = tags.get(278, (height,))[0], 0
    for k, (at, n) in enumerate(zip(tags[273], tags[279], strict=True)):
        y = k * rows if rows < height else y  # strips whose rows aren't told follow one another
        part = tiff_block(data[at : at + n], packed, (max(0, min(rows, height - y)), width), kind, predictor)
        page[y : y + len(part)] = part
        y += len(part)
    return page


def read_tiff(data: bytes) -> dict[str, np.ndarray]:
    """Pages of a classic or big TIFF in strips or tiles, plain, deflated or in LZW, with or without horizontal differences,
    stacked on the first axis.  A file without pages is an array without frames."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    pages = []
    while at:
        count, entry, width = (struct.unpack_from(order + "Q", data, at)[0], at + 8, 20) if big else (struct.unpack_from(order + "H", data, at)[0], at + 2, 12)
        tags = {}
        for k in range(count):
            tag, kind = struct.unpack_from(order + "HH", data, entry + k * width)
            n = struct.unpack_from(order + ("Q" if big else "I"), data, entry + k * width + 4)[0]
            inline = entry + k * width + (12 if big else 8)
            if kind in TIFF_CODES:
                if n * TIFF_SIZES[kind] > (8 if big else 4):
                    inline = struct.unpack_from(order + ("Q" if big else "I"), data, inline)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{TIFF_CODES[kind]}", data, inline)
        at = struct.unpack_from(order + ("Q" if big else "I"), data, entry + count * width)[0]
        bits, packed, form = tags.get(258, (1,))[0], tags.get(259, (1,))[0], tags.get(339, (1,))[0]
        if bits not in (8, 16) or form not in (1, 2) or tags.get(277, (1,))[0] != 1:
            raise ValueError("elements are not 8- or 16-bit whole numbers of one channel")
        if packed not in (1, 5, 8, 32946) or tags.get(317, (1,))[0] not in (1, 2):
            raise ValueError(f"compression {packed} is not none, LZW or deflate, or its predictor isn't horizontal")
        kind = ("<" if order == "<" else ">") + ("i" if form == 2 else "u") + str(bits // 8)
        pages.append(tiff_page(data, tags, kind))
    return {"": np.stack(pages) if pages else np.zeros((0, 0, 0), np.uint16)}


def read_dicom(data: bytes) -> dict[str, np.ndarray]:
    """Uncompressed little-endian pixels with explicit value representations."""
    if data[128:132] != b"DICM":
        raise ValueError("no DICM mark")
    at, tags = 132, {}
    while at + 8 <= len(data):
        group, element, vr = *struct.unpack_from("<HH", data, at), data[at + 4 : at + 6]
        if vr in (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"UC", b"UR", b"OD", b"OL"):
            size, start = struct.unpack_from("<I", data, at + 8)[0], at + 12
        else:
            size, start = struct.unpack_from("<H", data, at + 6)[0], at + 8
        if size == 0xFFFFFFFF:
            raise ValueError("values of undefined length aren't read")
        tags[group, element] = data[start : start + size]
        at = start + size
    number = lambda tag, other=0: struct.unpack("<H", tags[tag][:2])[0] if tag in tags else other
    rows, columns, bits, signed = number((0x28, 0x10)), number((0x28, 0x11)), number((0x28, 0x100)), number((0x28, 0x103))
    frames = int(tags.get((0x28, 0x08), b"1").strip(b" \0") or 1)
    return {"": np.frombuffer(tags[0x7FE0, 0x10], f"<{'i' if signed else 'u'}{bits // 8}", frames * rows * columns).reshape(frames, rows, columns)}


READERS: dict[str, Callable[[bytes], dict[str, np.ndarray]]] = {".npy": read_npy, ".npz": read_npz, ".stack": read_stack, ".nrrd": read_nrrd, ".nii": read_nifti, ".nii.gz": read_nifti, ".tif": read_tiff, ".tiff": read_tiff, ".dcm": read_dicom}


def reader_of(path: str) -> Callable[[bytes], dict[str, np.ndarray]]:
    for suffix in sorted(READERS, key=len, reverse=True):
        if path.endswith(suffix):
            return READERS[suffix]
    raise ValueError(f"no reader for {path}")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            for member, array in reader_of(path)(data).items():
                for t, volume in enumerate(lanes(array)):  # a frame at a time
                    z, y, x = (i.ravel() for i in np.indices(volume.shape, np.int32))
                    n = volume.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.rsplit("/", 1)[-1] + member] * n), pa.array(np.full(n, t, np.int32)), pa.array(z), pa.array(y), pa.array(x), pa.array(volume.ravel().astype(np.int32))],
                        names=["sample", "t", "z", "y", "x", "lane"],
                    )


def lattice(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(rows_of, LATTICE)


def small_file(spark: SparkSession, path: str) -> str:
    """A hidden file's text, which the file sources pass over, from any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def unpacked(data: bytes, codec: str | None, size: int) -> bytes:
    if codec == "zstd":
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    return zlib.decompress(data, 15 if codec == "zlib" else 31) if codec else data


def chunk_rows(spark: SparkSession, path: str, shape: list[int], chunks: list[int], kind: np.dtype, codec: str | None, separator: str, begin: str = "") -> DataFrame:
    """Lattice rows of an array in chunks, one file a chunk, named by ``begin`` and the chunk's place on every axis."""
    root = path.rstrip("/")
    name, size = root.rsplit("/", 1)[-1], int(np.prod(chunks)) * kind.itemsize
    pieces = len(chunks) if separator == "/" else 1  # parts of the path that hold the chunk's place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                place = "/".join(where.rsplit("/", pieces)[1:]).removeprefix(begin)
                corner = [int(i) * c for i, c in zip(place.split(separator), chunks, strict=True)]
                block = np.frombuffer(unpacked(data, codec, size), kind).reshape(chunks)[tuple(slice(0, max(0, n - a)) for n, a in zip(shape, corner, strict=True))]
                values = lanes(block)
                places = np.indices(values.shape, np.int32).reshape(4, -1)
                for axis, a in enumerate([0] * (4 - len(corner)) + corner):
                    places[axis] += a
                yield pa.RecordBatch.from_arrays([pa.array([name] * values.size), *(pa.array(p) for p in places), pa.array(values.ravel().astype(np.int32))], names=["sample", "t", "z", "y", "x", "lane"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{begin}[0-9]*").load(root).select("path", "content")
    return files.mapInArrow(run, LATTICE)


def zarr(spark: SparkSession, path: str) -> DataFrame:
    """Lattice rows of a zarr array of version 2 or 3: one task a chunk; absent chunks hold the fill value and give no rows.

    Version 2: chunks plain or packed by zlib, gzip or zstd, in C order, with any separator.  Version 3: a regular grid of
    either key encoding, bytes of either order, packed by gzip or zstd or not at all; chunks in shards, transposed or with
    checksums fail the query.
    """
    root = path.rstrip("/")
    if exists(spark, f"{root}/zarr.json"):
        return zarr_3(spark, root)
    meta = json.loads(small_file(spark, f"{root}/.zarray"))
    codec = (meta.get("compressor") or {}).get("id")
    if meta["order"] != "C" or meta.get("filters") or codec not in (None, "zlib", "gzip", "zstd"):
        raise ValueError("only plain, zlib, gzip or zstd chunks in C order without filters are read")
    return chunk_rows(spark, root, meta["shape"], meta["chunks"], np.dtype(meta["dtype"]), codec, meta.get("dimension_separator", "."))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def zarr_3(spark: SparkSession, root: str) -> DataFrame:
    meta = json.loads(small_file(spark, f"{root}/zarr.json"))
    first, *packed = meta["codecs"]
    if meta["node_type"] != "array" or meta["chunk_grid"]["name"] != "regular" or first["name"] != "bytes" or len(packed) > 1 or any(c["name"] not in ("gzip", "zstd") for c in packed):
        raise ValueError("only arrays in a regular grid of bytes, gzip or zstd chunks are read")
    order = ">" if first.get("configuration", {}).get("endian") == "big" else "<"
    keys = meta["chunk_key_encoding"]
    plain = keys["name"] == "v2"  # without the c in front
    separator = keys.get("configuration", {}).get("separator", "." if plain else "/")
    codec = packed[0]["name"] if packed else None
    begin = "" if plain or separator == "/" else f"c{separator}"
    return chunk_rows(spark, root, meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"], np.dtype(meta["data_type"]).newbyteorder(order), codec, separator, begin)


def samples(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(sample, bytes): the files of a source, without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("sample"), F.col("length").alias("bytes"))


def zip_members(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(archive, member, content): every member of every archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for member in z.namelist():
                        yield pd.DataFrame({"archive": [name.rsplit("/", 1)[-1]], "member": [member], "content": [z.read(member)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, content binary")


def decoded(column: str, codec: str):
    """A binary column decoded by a codec: raw, zlib or gzip inflate, or a pyarrow codec (zstd, lz4, lz4_raw, snappy with
    the size in the first eight bytes)."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        if codec in ("deflate", "zlib", "gzip"):
            bits = {"deflate": -15, "zlib": 15, "gzip": 31}[codec]
            return values.map(lambda b: None if b is None else zlib.decompress(b, bits))
        made = pa.Codec(codec)
        return values.map(lambda b: None if b is None else made.decompress(b[8:], int.from_bytes(b[:8], "little")).to_pybytes())

    return run(F.col(column))


def encoded_as(column: str, codec: str):
    """The inverse of decoded()."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        if codec in ("deflate", "zlib", "gzip"):
            bits = {"deflate": -15, "zlib": 15, "gzip": 31}[codec]

            def pack(b: bytes) -> bytes:
                made = zlib.compressobj(wbits=bits)
                return made.compress(b) + made.flush()

            return values.map(lambda b: None if b is None else pack(b))
        made = pa.Codec(codec)
        return values.map(lambda b: None if b is None else len(b).to_bytes(8, "little") + made.compress(b).to_pybytes())

    return run(F.col(column))


def seal(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """(group, root): a SHA-256 tree over each group's values: a digest of the ordered digests of blocks of values.

    A change of one value changes one block's digest and the root.
    """
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1
    leaves = df.withColumn("place", place).withColumn("leaf", F.sha2(F.concat_ws(":", F.col("place").cast("string"), F.col(value).cast("string")), 256))
    blocks = leaves.groupBy(*group, F.floor(F.col("place") / 1024).alias("block")).agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"])), 256).alias("digest"))
    return blocks.groupBy(*group).agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])), 256).alias("root"))
