"""MD5 of many short texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5
from math import sin

import numpy as np

TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
WORD = ((1, 0), (5, 1), (3, 5), (7, 0))
SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_heads(heads: np.ndarray, tails: Sequence[bytes]) -> np.ndarray:
    """(tail, head): the first eight bytes of md5(head + tail) as one number, in the order of the hexadecimal texts.

    heads is a matrix of bytes, a text a row; a head and a tail have 55 bytes at most, so that they fill one block.
    """
    n, size = heads.shape
    first, last = np.zeros((n, 64), np.uint8), np.zeros((len(tails), 64), np.uint8)
    first[:, :size] = heads
    for row, tail in zip(last, tails, strict=True):
        end = size + len(tail)
        row[size : end + 1] = [*tail, 0x80]
        row[56:58] = 8 * end % 256, 8 * end // 256
    words = []  # of the block: those that heads or tails alone fill stay a row or a column
    for row, column in zip(first.view("<u4").T, last.view("<u4").T, strict=True):
        words.append(row[None, :] + column[:, None] if row.any() and column.any() else row[None, :].copy() if row.any() else column[:, None].copy())
    a, b, c, d = (np.full((len(tails), n), s, np.uint32) for s in START)
    f = np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        step, offset = WORD[turn]
        f += a
        f += words[(step * i + offset) % 16] + np.uint32(SINES[i])
        by = TURNS[turn][i % 4]
        np.left_shift(f, by, out=a), np.right_shift(f, 32 - by, out=f)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    return a.byteswap().astype(np.uint64) << 32 | b.byteswap()
