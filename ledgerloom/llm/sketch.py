"""Sketches of sets that rule out pairs which cannot be similar, and never one that can.

For sets of similarity s or more, sizes differ by a factor of 1/s at most, and
|A xor B| <= (1 - s) / (1 + s) * (|A| + |B|). A sketch is the number of a set's elements and
256 bits that tell for each value of an 8-bit hash whether an odd number of elements have it.
Two sketches differ in at most as many bits as the sets in elements. Sets of more than
``FEW`` elements fill such a map evenly, similar or not; they have another one of 1024 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FEW = 160
SMALL_MAP = tuple(f"m{i}" for i in range(4))
LARGE_MAP = tuple(f"w{i}" for i in range(16))
MAPS = (*SMALL_MAP, *LARGE_MAP)
SKETCH = "size long, " + ", ".join(f"{m} long" for m in MAPS)


def sketches(hashes: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """The columns ``size`` and ``MAPS`` of sets whose elements' hashes follow each other, ``size`` of each with repeats."""
    bits = np.uint64(max(1, len(size).bit_length()))
    owner = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    rest = np.uint64(64) - bits
    own = np.sort((owner << rest) | (hashes >> bits))
    if len(own):
        own = own[np.concatenate(([True], own[1:] != own[:-1]))]
    owner = (own >> rest).astype(np.int64)
    at = (own >> (rest - np.uint64(10))) & np.uint64(1023)
    size = np.bincount(owner, minlength=len(size))
    large = size[owner] > FEW
    few = _parity(owner, at >> np.uint64(2), len(size), len(SMALL_MAP))
    many = _parity(owner[large], at[large], len(size), len(LARGE_MAP))
    return [
        pa.array(size, pa.int64()),
        *[pa.array(few[:, j].copy()) for j in range(len(SMALL_MAP))],
        *[pa.array(many[:, j].copy(), mask=size <= FEW) for j in range(len(LARGE_MAP))],
    ]


def _parity(owner: np.ndarray, at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Of each of ``n`` owners ``width`` words whose bit ``at`` is set if it has an odd number of these."""
    maps = np.zeros(n * width, np.uint64)
    np.bitwise_xor.at(maps, owner * width + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return maps.reshape(-1, width).view(np.int64)


def may_be_similar(similar: float, other: str = "other_") -> Column:
    """Whether two rows' sets can have that similarity; the second's columns start with ``other``.

    Two elements are to spare, for different ones with equal hashes and for rounding.
    """
    x, y = F.col("size"), F.col(f"{other}size")
    most = (x + y) * ((1 - similar) / (1 + similar)) + 2

    def differ(maps: tuple[str, ...]) -> Column:
        return sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{other}{m}"))) for m in maps), F.lit(0))

    near = F.greatest(x, y) * similar <= F.least(x, y) + 2
    return near & (differ(SMALL_MAP) <= most) & F.coalesce(differ(LARGE_MAP) <= most, F.lit(True))
