"""Rolling hashes of texts, and the cuts that contents define."""

from __future__ import annotations

import random

import numpy as np

#: Bytes under the rolling hash.
WINDOW = 16
#: Bytes hashed at a time: memory stays the same for a text of any length.
BLOCK = 1 << 20
_BASE = 0x9E3779B1
_TABLE = np.array(random.Random(16).sample(range(1 << 32), 256), dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash of the WINDOW bytes that end at each byte: the sum of table[byte] * base**distance in 32 bits. The first bytes of data have shorter windows.

    Windows of 2, 4, 8 and 16 bytes are put together from those of half their width, which gives what a byte-by-byte update would.
    """
    h, step, base = _TABLE[data], 1, _BASE
    while step < WINDOW:
        wider = h.copy()
        wider[step:] += np.uint32(base) * h[:-step]
        h, step, base = wider, step * 2, base * base & 0xFFFFFFFF
    return h


def cuts(data: np.ndarray, mean: int) -> np.ndarray:
    """Offsets after the windows whose hash is a multiple of mean (a power of two): equal bytes are cut alike wherever they stand, from their WINDOW-th on."""
    found = []
    for at in range(0, len(data), BLOCK):
        back = min(at, WINDOW - 1)
        hits = np.flatnonzero((rolling(data[at - back : at + BLOCK]) & np.uint32(mean - 1)) == 0) + (at - back + 1)
        found.append(hits[hits > at])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
