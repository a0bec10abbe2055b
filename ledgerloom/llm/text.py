"""Words and hashes of whole texts, batch by batch inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

# Text handled at once inside a task; arrays derived from it stay a small multiple of this.
SLICE_BYTES = 6 << 20


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of words, empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts add up to about ``most`` bytes (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words start and end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, bounds = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not filled.all():
        flat = flat.filter(pa.array(filled))
        bounds = np.concatenate(([0], np.cumsum(filled)))[bounds]
    return flat, bounds


def hashed(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; each distinct one is hashed once."""
    coded = flat.dictionary_encode()
    if not len(coded):
        return np.zeros(0, np.uint64)
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    return pd.util.hash_array(names, categorize=False)[np.asarray(coded.indices)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()
