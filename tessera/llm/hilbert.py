"""Positions along a Hilbert curve, for whole arrays of grid points."""

from __future__ import annotations

import numpy as np


def positions(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of points (n, dims), coordinates in [0, 2**bits); dims * bits <= 62.

    The coordinates are rotated and reflected from the highest bit down, Gray-decoded, and their
    bits interleaved.
    """
    x = np.array(points, dtype=np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out
