"""Hashed character n-grams over whole texts, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

BOUNDARY = 0


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or BOUNDARY for anything that is no letter."""
    table = np.zeros(0x10000, dtype=np.uint32)
    for point in range(0x10000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else point
    return table


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters with one boundary before, between and after the words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _letters()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        kinds, which = np.unique(points[high], return_inverse=True)
        codes[high] = np.array([ord(low) if (c := chr(p)).isalpha() and len(low := c.lower()) == 1 else BOUNDARY for p in kinds.tolist()], dtype=np.uint32)[which]
    codes = np.concatenate(([BOUNDARY], codes, [BOUNDARY])).astype(np.uint32)
    doubled = (codes[1:] == BOUNDARY) & (codes[:-1] == BOUNDARY)
    return codes[np.concatenate(([True], ~doubled))]


def gram_buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of each run of `order` codes, out of 2**bits."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    out = np.full(n, order, dtype=np.uint32)
    for k in range(order):
        out *= np.uint32(0x01000193)
        out += codes[k : k + n]
        out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out >> np.uint32(32 - bits)
