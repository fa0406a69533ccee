"""Simple-8b word-aligned coding of integer sequences, encoded and decoded as arrays.

A word of 64 bits holds a selector in its low 4 bits and, above it, as many values of equal width as fit in 60 bits.
Of the widths that hold the values ahead, the one that packs most values is taken.  Values are coded in blocks of
``BLOCK`` values that start on a word of their own, and the offsets of the blocks are stored, so that all blocks are
decoded at once.  A value of 60 bits or more is an escape: its word holds a place in a list of full 64-bit values at
the end of the record.

Record, little-endian: u32 values, u32 blocks, u32 words, u32 escapes; u32 first word of every block; u64 words;
u64 escaped values.
"""

from __future__ import annotations

import numpy as np

#: Selector k packs COUNTS[k] values of WIDTHS[k] bits.  Fixed values of the format.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 15
BLOCK = 1024


def bit_lengths(values: np.ndarray) -> np.ndarray:
    limits = np.left_shift(np.uint64(1), np.arange(61, dtype=np.uint64))
    return np.searchsorted(limits, values, side="right").astype(np.int8)


def longest_runs(bits: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The selector with most values for a word that starts at each place; room: values to the end of the block."""
    best = np.full(len(bits), ESCAPE, np.int8)
    best[bits <= 60] = 14
    reach, widest = 1, bits.copy()  # widest[i]: over reach values from i
    for k in range(13, -1, -1):
        n = int(COUNTS[k])
        while reach < n:
            step = min(reach, n - reach)
            widest[:-step or None] = np.maximum(widest[:-step or None], np.append(widest[step:], np.zeros(0, np.int8))[: len(widest) - step])
            reach += step
        fits = (widest <= WIDTHS[k]) & (room >= n)
        if not fits.any() and (widest > WIDTHS[k]).all():
            break  # longer words take narrower values yet
        best[fits] = k
    return best


def encode(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.uint64)
    total = len(values)
    blocks = -(-total // BLOCK)
    if not total:
        return np.zeros(4, "<u4").tobytes()
    place = np.arange(total)
    room = np.minimum(BLOCK - place % BLOCK, total - place)
    bits = bit_lengths(values)
    choice = longest_runs(bits, room)
    taken = COUNTS[choice]
    # All blocks are walked side by side, one word a step.
    at = np.arange(blocks) * BLOCK
    ends = np.minimum(at + BLOCK, total)
    begins = np.zeros(total, bool)
    while len(at):
        begins[at] = True
        at = at + taken[at]
        on = at < ends
        at, ends = at[on], ends[on]
    first = np.flatnonzero(begins)
    selectors = choice[first]
    words = selectors.astype(np.uint64)
    for k in range(1, 15):
        mine = np.flatnonzero(selectors == k)
        if len(mine):
            part = values[first[mine][:, None] + np.arange(COUNTS[k])]
            shifts = (4 + np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(part << shifts, axis=1)
    out = np.flatnonzero(selectors == ESCAPE)
    words[out] |= np.arange(len(out), dtype=np.uint64) << np.uint64(4)
    offsets = np.searchsorted(first, np.arange(blocks) * BLOCK)
    head = np.array([total, blocks, len(words), len(out)], "<u4")
    return head.tobytes() + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes() + values[first[out]].astype("<u8").tobytes()


def decode(record: bytes) -> np.ndarray:
    total, blocks, count, escapes = np.frombuffer(record, "<u4", 4).tolist()
    words = np.frombuffer(record, "<u8", count, 16 + 4 * blocks)
    escaped = np.frombuffer(record, "<u8", escapes, 16 + 4 * blocks + 8 * count)
    return unpack(words, escaped, total)


def decode_block(record: bytes, block: int) -> np.ndarray:
    """The values of one block alone, found by its offset."""
    total, blocks, count, escapes = np.frombuffer(record, "<u4", 4).tolist()
    offsets = np.append(np.frombuffer(record, "<u4", blocks, 16), count)
    words = np.frombuffer(record, "<u8", count, 16 + 4 * blocks)[offsets[block] : offsets[block + 1]]
    escaped = np.frombuffer(record, "<u8", escapes, 16 + 4 * blocks + 8 * count)
    return unpack(words, escaped, min(BLOCK, total - block * BLOCK))


def unpack(words: np.ndarray, escaped: np.ndarray, total: int) -> np.ndarray:
    selectors = (words & np.uint64(15)).astype(np.int64)
    first = np.cumsum(COUNTS[selectors]) - COUNTS[selectors]
    out = np.zeros(total, np.uint64)
    for k in range(1, 15):
        mine = np.flatnonzero(selectors == k)
        if len(mine):
            shifts = (4 + np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
            mask = np.uint64((1 << int(WIDTHS[k])) - 1)
            out[first[mine][:, None] + np.arange(COUNTS[k])] = (words[mine][:, None] >> shifts) & mask
    mine = np.flatnonzero(selectors == ESCAPE)
    out[first[mine]] = escaped[(words[mine] >> np.uint64(4)).astype(np.int64)]
    return out
