"""Whole texts as arrays: bounded slices of Arrow batches, word bounds and 64-bit hashes without a loop per word."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word hashes are polynomials modulo this prime; modulo 2^64, sums of powers of any odd base would vanish on
#: crafted texts (Thue-Morse words and their complements).  Their base is a key drawn when a job or a worker starts: whoever
#: knows the base can compute two words with one hash.
PRIME = (1 << 61) - 1


def slices(lengths: list[int], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters each; a longer text is alone in its range, and whole."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(column: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int, pa.Array]]:
    """(start, end, rows) of a string column in slices() of its texts, so that few of them are Python objects at once."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(lengths, limit):
        yield a, b, column.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word over the others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def low(x: np.ndarray, bits: int) -> np.ndarray:
    return x & np.uint64((1 << bits) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = low(x, 61) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def shifted(x: np.ndarray, bits: int) -> np.ndarray:
    """x * 2^bits modulo PRIME, not fully reduced: the bits that pass 2^61 come back at the bottom."""
    return (x >> np.uint64(61 - bits)) + (low(x, 61 - bits) << np.uint64(bits))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, from products of their 32-bit halves."""
    half = np.uint64(32)
    a1, a0, b1, b0 = a >> half, low(a, 32), b >> half, low(b, 32)
    lowest = a0 * b0
    return reduced((a1 * b1 << np.uint64(3)) + shifted(a1 * b0 + a0 * b1, 32) + low(lowest, 61) + (lowest >> np.uint64(61)))


def new_key() -> int:
    """A key that no text can have been made for."""
    return 2 + secrets.randbelow(PRIME - 3)


class Powers:
    """Powers of a key and of its inverse modulo PRIME, grown as needed."""

    def __init__(self, key: int) -> None:
        self.bases = key, pow(key, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up, self.down = (np.concatenate([x, product(x, np.uint64(pow(b, size, PRIME)))]) for x, b in zip((self.up, self.down), self.bases, strict=True))
        return self.up, self.down


@cache
def powers(key: int) -> Powers:
    return Powers(key)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """64-bit hash of values[start:end] (values below 2^21) for every span, by prefix sums of a polynomial.

    Two spans that don't depend on the key collide with a chance of about their length over 2^61.
    """
    up, down = powers(key).upto(len(values) + 1)
    up = up[: len(values)]
    value = values.astype(np.uint64) + np.uint64(1)
    term = shifted(value * (up >> np.uint64(31)), 31) + value * low(up, 31)
    sums = np.zeros((2, len(values) + 1), np.uint64)  # of the halves, so that no sum passes 2^64
    np.cumsum(term >> np.uint64(31), out=sums[0, 1:])
    np.cumsum(low(term, 31), out=sums[1, 1:])
    total = reduced(shifted(reduced(sums[0, ends] - sums[0, starts]), 31) + sums[1, ends] - sums[1, starts])
    return mix(product(total, down[starts]) + ((ends - starts).astype(np.uint64) << np.uint64(32)))


def differ(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, others: np.ndarray, begins: np.ndarray) -> bool:
    """Whether any span of ``values`` differs from the span of equal size that begins at begins[i] in ``others``."""
    last = np.cumsum(sizes)
    run = np.arange(int(last[-1]) if len(last) else 0) - np.repeat(last - sizes, sizes)
    return bool((values[np.repeat(starts, sizes) + run] != others[np.repeat(begins, sizes) + run]).any())


def unequal(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Spans that differ from the span of[i] that stands for them."""
    size = ends - starts
    other = starts[of]
    wrong = size != ends[of] - other
    to = np.flatnonzero((other != starts) & ~wrong)
    if len(to):
        n = size[to]
        last = np.cumsum(n)
        run = np.arange(int(last[-1])) - np.repeat(last - n, n)
        off = values[np.repeat(starts[to], n) + run] != values[np.repeat(other[to], n) + run]
        if off.any():
            wrong[to[np.unique(np.searchsorted(last, np.flatnonzero(off), side="right"))]] = True
    return np.flatnonzero(wrong)


def word_spans(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): the words of all texts after translating by ``table``, in which 0x20 parts words.

    first[i]:first[i + 1] are the words of text i.
    """
    joined = b" ".join([b"", *texts, b""]).translate(table)
    data = np.frombuffer(joined, np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(starts, bounds)


class HashTable:
    """Whole numbers by 64-bit hash, in sorted arrays: a large one and a small one of what came last.

    Past ``limit`` entries it says that it is full; the owner then starts afresh.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def full(self, more: int) -> bool:
        return len(self) > 0 and len(self) + more > self.limit

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is unknown."""
        out = np.full(len(keys), -1, np.int64)
        for known, values in self.parts:
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[place] == keys
                out[hit] = values[place[hit]]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds unknown keys."""
        large, small = self.parts
        small = self.merged(small, (keys, values.astype(np.int32)))
        if len(small[0]) > max(1 << 16, len(large[0]) // 8):
            large, small = self.merged(large, small), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.parts = [large, small]

    @staticmethod
    def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, values = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]
