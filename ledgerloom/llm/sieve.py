"""A bitmap of fixed size that tells most absent hashes from present ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of the map: 16 MB, however many hashes it holds. A full map only sieves less.
BITS = 1 << 27


class Sieve:
    """Which hashes may be in a set: never wrong about those that are."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & np.uint64(BITS - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def sieve(hashes: DataFrame, column: str) -> Sieve:
    """Sieve of a column of evenly spread 64-bit hashes, built by Spark one page of bits a group."""
    # The bitmap functions number from one.
    at = F.col(column).bitwiseAND(F.lit(BITS - 1)) + 1
    pages = (
        hashes.select(at.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    )
    bits = np.zeros(BITS // 8, np.uint8)
    for row in pages.toLocalIterator():  # 4096 pages of 4 kB at most
        raw = np.frombuffer(bytes(row["bits"]), np.uint8)
        start = (row["page"] - 1) * len(raw)
        bits[start : start + len(raw)] = raw
    return Sieve(bits)
