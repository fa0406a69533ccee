"""Lossless coding of lanes: differences to the lane before, folded to whole numbers from 0, in Rice codes by blocks.

A block of BLOCK lanes takes the parameter k (0 to 15) that makes it shortest and is written as k in four bits and, for
each number v, v >> k ones, a zero and the last k bits of v.  The last block may be shorter.
"""

from __future__ import annotations

import numpy as np

BLOCK, PARAMETERS = 64, 16


def folded(lanes: np.ndarray) -> np.ndarray:
    step = np.diff(lanes.astype(np.int64), prepend=0)
    return np.where(step >= 0, 2 * step, -2 * step - 1)


def unfolded(numbers: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(numbers % 2 == 0, numbers // 2, -(numbers + 1) // 2))


def parameters(numbers: np.ndarray) -> np.ndarray:
    """The best parameter of every block (ties: the smallest)."""
    blocks = -(-len(numbers) // BLOCK)
    of = np.arange(len(numbers)) // BLOCK
    cost = np.stack([np.bincount(of, 1 + k + (numbers >> k), blocks) for k in range(PARAMETERS)])
    return cost.argmin(0)


def encode(lanes: np.ndarray) -> tuple[bytes, int]:
    """(bytes, bits used)."""
    numbers = folded(lanes)
    ks = parameters(numbers)
    k = np.repeat(ks, BLOCK)[: len(numbers)]
    ones = numbers >> k
    head = np.where(np.arange(len(numbers)) % BLOCK == 0, 4, 0)
    size = head + ones + 1 + k
    start = np.cumsum(size) - size
    total = int(size.sum())
    bits = np.zeros(total, np.uint8)
    first = np.flatnonzero(head)
    for b in range(4):
        bits[start[first] + b] = (ks >> (3 - b)) & 1
    run = np.arange(int(ones.sum())) - np.repeat(np.cumsum(ones) - ones, ones)
    bits[np.repeat(start + head, ones) + run] = 1
    tail = start + head + ones + 1
    for b in range(PARAMETERS):
        has = np.flatnonzero(k > b)
        bits[tail[has] + k[has] - 1 - b] = (numbers[has] >> b) & 1
    return np.packbits(bits).tobytes(), total


def decode(data: bytes, count: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    zeros = np.flatnonzero(bits == 0)
    places, flags = zeros.tolist(), bits.tolist()
    out, at, z, k = [], 0, 0, 0
    for i in range(count):
        if i % BLOCK == 0:
            k = flags[at] << 3 | flags[at + 1] << 2 | flags[at + 2] << 1 | flags[at + 3]
            at += 4
            z = int(np.searchsorted(zeros, at))
        while places[z] < at:
            z += 1
        value, at = places[z] - at, places[z] + 1
        for b in flags[at : at + k]:
            value = value << 1 | b
        at += k
        out.append(value)
    return unfolded(np.array(out, np.int64))


ESCAPE, RAW, HEAD, WIDEST = 24, 32, 5, 24  # ones that announce RAW bits; bits of a block's parameter; its largest value


def zigzag(values: np.ndarray) -> np.ndarray:
    return np.where(values >= 0, 2 * values, -2 * values - 1)


def unzigzag(numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers % 2 == 0, numbers // 2, -(numbers + 1) // 2)


def widths(numbers: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Bits of each number under a parameter: its quotient in ones, a zero and k bits, or the escape."""
    quotient = numbers >> k
    return np.where(quotient < ESCAPE, quotient + 1 + k, ESCAPE + RAW)


def pack(numbers: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """(bytes, bits, first bit of every block) of numbers from 0 below 2^RAW, in blocks of BLOCK with the parameter that makes each
    shortest (ties: the smallest)."""
    if not len(numbers):
        return b"", 0, np.zeros(0, np.int64)
    blocks, of = -(-len(numbers) // BLOCK), np.arange(len(numbers)) // BLOCK
    ks = np.stack([np.bincount(of, widths(numbers, k), blocks) for k in range(WIDEST + 1)]).argmin(0)
    k = ks[of]
    quotient = numbers >> k
    far = quotient >= ESCAPE
    size = widths(numbers, k)
    heads = HEAD * (of + 1)
    end = np.cumsum(size) + heads
    start = end - size
    total = int(end[-1])
    bits = np.zeros(total, np.uint8)
    first = start[::BLOCK] - HEAD
    for b in range(HEAD):
        bits[first + b] = ks >> (HEAD - 1 - b) & 1
    ones = np.where(far, ESCAPE, quotient)
    run = np.arange(int(ones.sum())) - np.repeat(np.cumsum(ones) - ones, ones)
    bits[np.repeat(start, ones) + run] = 1
    tail = np.where(far, RAW, k)
    for b in range(RAW):
        has = np.flatnonzero(tail > b)
        bits[end[has] - 1 - b] = numbers[has] >> b & 1
    return np.packbits(bits).tobytes(), total, first


def unpack(data: bytes, count: int, first: np.ndarray) -> np.ndarray:
    """The numbers of pack(): the blocks are read side by side, one number of each at a time, from their own first bits."""
    out = np.zeros(len(first) * BLOCK, np.int64)
    if not count:
        return out[:0]
    bits = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8)), np.zeros(RAW + WIDEST + 1, np.uint8)])
    zero = np.where(bits == 0, np.arange(len(bits)), len(bits))
    zero = np.minimum.accumulate(zero[::-1])[::-1]  # the next zero from every place on

    def number(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.int64)
        for b in range(int(size.max(initial=0))):
            more = size > b
            value[more] = value[more] << 1 | bits[at[more] + b]
        return value

    at = first.astype(np.int64)
    k = number(at, np.full(len(at), HEAD))
    at = at + HEAD
    for j in range(BLOCK):
        live = np.flatnonzero(np.arange(len(first)) * BLOCK + j < count)
        ones = zero[at[live]] - at[live]
        far = ones >= ESCAPE
        begin = at[live] + np.where(far, ESCAPE, ones + 1)
        size = np.where(far, RAW, k[live])
        low = number(begin, size)
        out[live * BLOCK + j] = np.where(far, low, (ones << k[live]) + low)
        at[live] = begin + size
    return out[:count]
