"""Hilbert order of points of an integer lattice."""

from __future__ import annotations

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (points, axes) with ``bits`` bits an axis;
    axes * bits <= 64.  The coordinates are turned into the transposed index (undo the excess work
    of each level from the top bit down, then Gray-decode) and its bits interleaved."""
    x = cells.astype(np.uint64).T.copy()
    axes = len(x)
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        low = level - np.uint64(1)
        for i in range(axes):
            set_ = (x[i] & level) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        level >>= np.uint64(1)
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - np.uint64(1), np.uint64(0))
        level >>= np.uint64(1)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key
