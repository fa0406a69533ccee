"""HDF5 files by byte ranges: where a dataset's chunks lie, and files of one chunked dataset.

Read: superblocks of version 0 and 1, object headers of version 1 with continuations, groups of symbol tables, datasets that are
contiguous or in chunks listed by a B-tree of version 1, packed by deflate, shuffled, or with a Fletcher checksum.  Whatever
else a file uses fails with its name.  ``read(at, size)`` gives bytes of the file; only headers and the parts of the tree
that are asked for are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np

Read = Callable[[int, int], bytes]
Bounds = list[tuple[int, int]]  # of every axis: first and last place

#: Fixed values of the format.
SIGNATURE, NONE = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
DATASPACE, DATATYPE, FILL, LINK, LAYOUT, FILTERS, CONTINUATION, SYMBOLS = 0x1, 0x3, 0x5, 0x6, 0x8, 0xB, 0x10, 0x11
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3
LEAF, INNER, CHUNK_NODE = 4, 16, 32  # entries of a node are at most twice as many


@dataclass
class Dataset:
    shape: tuple[int, ...]
    kind: np.dtype
    chunks: tuple[int, ...]
    root: int  # address of the chunk tree, or of the data
    tree: bool
    filters: list[tuple[int, list[int]]] = field(default_factory=list)


def word(data: bytes, at: int, size: int = 8) -> int:
    return int.from_bytes(data[at : at + size], "little")


def root_header(read: Read) -> int:
    head = read(0, 96)
    if head[:8] != SIGNATURE:
        raise ValueError("not an HDF5 file that begins at its first byte")
    if head[8] > 1 or head[13] != 8 or head[14] != 8:
        raise ValueError(f"superblock version {head[8]} with addresses of {head[13]} bytes isn't read")
    return word(head, 64 + 4 * head[8])


def messages(read: Read, at: int) -> dict[int, bytes]:
    """The messages of an object header; of several of one kind, the first."""
    head = read(at, 16)
    if head[0] != 1:
        raise ValueError(f"object header version {head[0]} isn't read")
    left, blocks, out = word(head, 2, 2), [(at + 16, word(head, 8, 4))], {}
    while blocks and left:
        place, size = blocks.pop(0)
        data, p = read(place, size), 0
        while p + 8 <= size and left:
            kind, n = struct.unpack_from("<HH", data, p)
            body = data[p + 8 : p + 8 + n]
            if kind == CONTINUATION:
                blocks.append((word(body, 0), word(body, 8)))
            else:
                out.setdefault(kind, body)
            p, left = p + 8 + n, left - 1
    return out


def members(read: Read, tree: int, heap: int) -> dict[str, int]:
    """Addresses of a group's objects by name."""
    head = read(heap, 32)
    names, out, open_ = read(word(head, 24), word(head, 8)), {}, [tree]
    while open_:
        at = open_.pop()
        head = read(at, 24)
        if head[:4] == b"SNOD":
            used = word(head, 6, 2)
            entries = read(at + 8, 40 * used)
            for i in range(used):
                name = names[word(entries, 40 * i) :]
                out[name[: name.index(0)].decode()] = word(entries, 40 * i + 8)
        else:
            used = word(head, 6, 2)
            body = read(at + 24, 16 * used + 8)
            open_ += [word(body, 16 * i + 8) for i in range(used)]
    return out


def number_type(body: bytes) -> np.dtype:
    kind, flags, size = body[0] & 15, body[1], word(body, 4, 4)
    if kind > 1:
        raise ValueError(f"elements of class {kind} aren't read")
    return np.dtype((">" if flags & 1 else "<") + ("f" if kind else "i" if flags & 8 else "u") + str(size))


def dataset(read: Read, path: str) -> Dataset:
    at = root_header(read)
    found = messages(read, at)
    for name in [p for p in path.split("/") if p]:
        if SYMBOLS not in found:
            raise ValueError("groups without symbol tables aren't read" if LINK in found else f"no group that holds {name}")
        inside = members(read, *struct.unpack("<QQ", found[SYMBOLS][:16]))
        if name not in inside:
            raise ValueError(f"no object {name}")
        found = messages(read, inside[name])
    missing = [k for k in (DATASPACE, DATATYPE, LAYOUT) if k not in found]
    if missing:
        raise ValueError(f"{path} is no dataset")
    space, layout = found[DATASPACE], found[LAYOUT]
    begin = 8 if space[0] == 1 else 4
    shape = struct.unpack_from(f"<{space[1]}Q", space, begin)
    kind = number_type(found[DATATYPE])
    if layout[0] != 3 or layout[1] not in (1, 2):
        raise ValueError(f"layout version {layout[0]}, class {layout[1]}, isn't read")
    if layout[1] == 1:
        return Dataset(shape, kind, (1, *shape[1:]) if shape else (), word(layout, 2), False)  # taken a slab of the first axis at a time
    chunks = struct.unpack_from(f"<{layout[2] - 1}I", layout, 11)
    return Dataset(shape, kind, chunks, word(layout, 3), True, pipeline(found.get(FILTERS, b"")))


def pipeline(body: bytes) -> list[tuple[int, list[int]]]:
    out, p = [], 8 if body[:1] == b"\1" else 2
    for _ in range(body[1] if body else 0):
        kind, name, _, count = struct.unpack_from("<HHHH", body, p)
        p += 8 + (name + 7) // 8 * 8
        out.append((kind, list(struct.unpack_from(f"<{count}I", body, p))))
        p += 4 * (count + count % 2)
    return out


def inside(corner: tuple[int, ...], chunks: tuple[int, ...], bounds: Bounds) -> bool:
    return all(a <= hi and a + c > lo for a, c, (lo, hi) in zip(corner, chunks, bounds, strict=True))


def chunk_ranges(read: Read, of: Dataset, bounds: Bounds) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
    """(corner, address, bytes, filters left out) of the chunks that meet the bounds.

    Parts of the tree whose first axis lies outside aren't read.
    """
    n = len(of.shape)
    if not of.tree:
        slab = int(np.prod(of.chunks)) * of.kind.itemsize
        if of.root != NONE:
            yield from (((i, *(0,) * (n - 1)), of.root + i * slab, slab, 0) for i in range(bounds[0][0], bounds[0][1] + 1)) if n else [((), of.root, slab, 0)]
        return
    key, open_ = 8 + 8 * (n + 1), [of.root] if of.root != NONE else []
    lo, hi = bounds[0]
    while open_:
        at = open_.pop()
        head = read(at, 24)
        used = word(head, 6, 2)
        body = read(at + 24, used * (key + 8) + key)
        for i in range(used):
            p = i * (key + 8)
            size, mask = struct.unpack_from("<II", body, p)
            corner, child = struct.unpack_from(f"<{n}Q", body, p + 8), word(body, p + key)
            if head[5]:
                if corner[0] <= hi and word(body, p + key + 8 + 8) + of.chunks[0] > lo:
                    open_.append(child)
            elif inside(corner, of.chunks, bounds):
                yield corner, child, size, mask


def unpacked(of: Dataset, data: bytes, mask: int) -> np.ndarray:
    """A chunk's elements."""
    for i, (kind, values) in reversed(list(enumerate(of.filters))):
        if mask >> i & 1:
            continue
        if kind == DEFLATE:
            data = zlib.decompress(data)
        elif kind == SHUFFLE:
            data = np.frombuffer(data, np.uint8).reshape(values[0], -1).T.tobytes()
        elif kind == FLETCHER:
            data = data[:-4]
        else:
            raise ValueError(f"filter {kind} isn't read")
    return np.frombuffer(data, of.kind).reshape(of.chunks)


def padded(body: bytes) -> bytes:
    return body + b"\0" * (-len(body) % 8)


def header(*found: tuple[int, bytes]) -> bytes:
    body = b"".join(struct.pack("<HHB3x", kind, len(padded(b)), 0) + padded(b) for kind, b in found)
    return struct.pack("<BxHIi4x", 1, len(found), 1, len(body)) + body


def write(a: np.ndarray, chunks: tuple[int, ...], name: str = "lattice", level: int = 1) -> bytes:
    """A file with one dataset of unsigned 16-bit elements in shuffled and deflated chunks."""
    n, out = a.ndim, bytearray(96)

    def put(data: bytes, room: int = 0) -> int:
        out.extend(b"\0" * (-len(out) % 8))
        at = len(out)
        out.extend(data.ljust(room, b"\0"))
        return at

    nodes = []  # (first key, address)
    for corner in np.ndindex(*(-(-s // c) for s, c in zip(a.shape, chunks, strict=True))):
        begin = [i * c for i, c in zip(corner, chunks, strict=True)]
        block = np.zeros(chunks, "<u2")
        part = a[tuple(slice(b, b + c) for b, c in zip(begin, chunks, strict=True))]
        block[tuple(slice(0, s) for s in part.shape)] = part
        data = zlib.compress(block.view(np.uint8).reshape(-1, 2).T.tobytes(), level)
        nodes.append((struct.pack(f"<II{n + 1}Q", len(data), 0, *begin, 0), put(data)))
    last = struct.pack(f"<II{n + 1}Q", 0, 0, *(-(-s // c) * c for s, c in zip(a.shape, chunks, strict=True)), 0)
    depth, room = 0, 24 + (2 * CHUNK_NODE + 1) * len(last) + 2 * CHUNK_NODE * 8
    while True:
        groups = list(batched(nodes, 2 * CHUNK_NODE))
        ends = [g[0][0] for g in groups[1:]] + [last]
        above = []
        for group, end in zip(groups, ends, strict=True):
            body = b"".join(key + struct.pack("<Q", child) for key, child in group) + end
            above.append((group[0][0], put(struct.pack("<4sBBHQQ", b"TREE", 1, depth, len(group), NONE, NONE) + body, room)))
        nodes, depth = above, depth + 1
        if len(nodes) <= 1:
            break
    space = struct.pack(f"<BBB5x{n}Q", 1, n, 0, *a.shape)
    kind = struct.pack("<BBBBIHH", 0x10, 0, 0, 0, 2, 0, 16)
    layout = struct.pack(f"<BBBQ{n + 1}I", 3, 2, n + 1, nodes[0][1] if nodes else NONE, *chunks, 2)
    filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", SHUFFLE, 0, 1, 1, 2) + struct.pack("<HHHHI4x", DEFLATE, 0, 1, 1, level)
    data = put(header((DATASPACE, space), (DATATYPE, kind), (FILL, struct.pack("<BBBB", 2, 3, 2, 0)), (LAYOUT, layout), (FILTERS, filters)))
    names = b"\0" * 8 + padded(name.encode() + b"\0")
    heap = put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), 1, put(names)))
    symbols = put(struct.pack("<4sBxH", b"SNOD", 1, 1) + struct.pack("<QQI4x16x", 8, data, 0), 8 + 40 * 2 * LEAF)
    tree = put(struct.pack("<4sBBHQQ", b"TREE", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, symbols, 8), 24 + (2 * INNER + 1) * 8 + 2 * INNER * 8)
    top = put(header((SYMBOLS, struct.pack("<QQ", tree, heap))))
    out[:96] = SIGNATURE + struct.pack("<BBBxBBBxHHIQQQQ", 0, 0, 0, 0, 8, 8, LEAF, INNER, 0, 0, NONE, len(out), NONE) + struct.pack("<QQI4xQQ", 0, top, 1, tree, heap)
    return bytes(out)
