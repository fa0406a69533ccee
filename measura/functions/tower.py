"""Lifting towers on whole numbers: the reversible 5/3 step on every axis, level after level, and its inverse.

A step along an axis splits the places of the level (multiples of its stride) into odd and even ones:

    high = odd - floor((even before + even after) / 2),   low = even + floor((high before + high after + 2) / 4)

with the neighbour on the other side where one is missing.  Coefficients stay at their places; the next level goes on with the
even ones.  A block of a larger lattice that carries ``halo(levels)`` places of its neighbours gets the coefficients that the
whole lattice would give it.
"""

from __future__ import annotations

import numpy as np


def halo(levels: int) -> int:
    """Places beyond a block on which its coefficients, or its values from coefficients, depend: a multiple of the last
    stride, so that places keep their parity on every level."""
    return 4 << levels


def halves(a: np.ndarray, axis: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    moved = np.moveaxis(a, axis, 0)[::stride]
    return moved[0::2], moved[1::2]


def beside(part: np.ndarray, count: int, back: bool) -> np.ndarray:
    """For each of ``count`` places between or around those of ``part``, the one before (or after) it, or the only one there is."""
    at = np.arange(count) - 1 if back else np.arange(count)
    other = at + (1 if back else -1)
    at = np.where((at < 0) | (at >= len(part)), other, at)
    return part[np.clip(at, 0, len(part) - 1)]


def step(a: np.ndarray, axis: int, stride: int, forward: bool) -> None:
    """One lifting step in place over the level's places (views of ``a``)."""
    even, odd = halves(a, axis, stride)
    if not len(odd):
        return
    n = len(odd)
    # Odd place i lies between the even places i and i + 1, even place i between the odd places i - 1 and i.
    around = lambda: even[:n] + even[np.minimum(np.arange(1, n + 1), len(even) - 1)]
    near = lambda: beside(odd, len(even), True) + beside(odd, len(even), False)
    if forward:
        odd -= around() // 2
        even += (near() + 2) // 4
    else:
        even -= (near() + 2) // 4
        odd += around() // 2


def lift(a: np.ndarray, levels: int) -> np.ndarray:
    """Coefficients of a lattice, each level along all axes from the last to the first."""
    out = a.astype(np.int64)
    for level in range(levels):
        part = out[tuple(slice(None, None, 1 << level) for _ in range(a.ndim))]
        for axis in range(a.ndim - 1, -1, -1):
            step(part, axis, 1, True)
    return out


def lower(a: np.ndarray, levels: int) -> np.ndarray:
    """The lattice of the coefficients."""
    out = a.astype(np.int64)
    for level in range(levels - 1, -1, -1):
        part = out[tuple(slice(None, None, 1 << level) for _ in range(a.ndim))]
        for axis in range(a.ndim):
            step(part, axis, 1, False)
    return out
