"""Periodic runs of words: stretches that repeat their first few words over and over.

A run of period q makes its first position and the one q words on share their next
words, as many as the run is long but for q. So suffixes of a text are united into
classes by decreasing length of their common prefix (Kruskal over the suffix array's
neighbours). When two classes become one, the positions that are neighbours only now
are looked at: a pair no further apart than its common prefix is periodic, and its
distance is the smallest period there, as a smaller one would put a position of the
same class between the two.

Only windows of words that a text has twice can take part, so all others are taken out
before suffixes are sorted. Each task works on a few megabytes of whole texts at once;
nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import mixed, slices, split_words

LEAST_WORDS = 6
LEAST_REPEATS = 4

RUN_SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def least_common(least: int, repeats: int) -> int:
    """Shortest common prefix that the first pair of an admitted run can have."""
    return min(max(least - q, (repeats - 1) * q) for q in range(1, least + 1))


def repeated_windows(codes: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows of ``width`` words that occur twice in their text (a few others may be among them)."""
    if len(codes) < width:
        return np.zeros(0, np.int64)
    key = mixed(owner[: len(codes) - width + 1].astype(np.uint64) + np.uint64(1))
    for j in range(width):
        key = mixed(key ^ codes[j : len(codes) - width + 1 + j].astype(np.uint64))
    inside = np.flatnonzero(owner[: len(key)] == owner[width - 1 :])
    if not len(inside):
        return inside
    order = inside[np.argsort(key[inside])]
    same = key[order][1:] == key[order][:-1]
    return np.sort(order[np.append(same, False) | np.append(False, same)])


def compacted(codes: np.ndarray, owner: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the stretches that ``starts`` cover, each ended by a symbol of its own, and their word numbers.

    A word's symbol tells its text, so different texts share none; the word number of an end is -1.
    """
    first = np.append(True, np.diff(starts) > 1)
    stretch = np.cumsum(first) - 1
    begin, size = starts[first], np.bincount(stretch) + width
    base = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(base - begin, size)
    ends = base + size - 1
    place[ends] = -1
    _, symbols = np.unique(owner[place].astype(np.int64) * (int(codes.max()) + 1) + codes[place], return_inverse=True)
    symbols[ends] = len(symbols) + np.arange(len(ends))
    return symbols.astype(np.int64), place


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and each neighbour pair's common prefix, by doubling; the last symbol must be unique."""
    m = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    levels, step = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while rank[order[-1]] < m - 1:
        after = np.zeros(m, np.int64)
        after[: m - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (m + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(m, np.int64)
        rank[order] = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        levels.append(rank.astype(np.int32))
        step *= 2
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(m - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        more = np.flatnonzero(levels[k][left] == levels[k][right]) if m > 1 else np.zeros(0, np.int64)
        left[more] += 1 << k
        right[more] += 1 << k
        common[more] += 1 << k
    return order, common


def seeds(place: np.ndarray, order: np.ndarray, common: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """``(first, distance, common prefix)`` of positions that become neighbours at a prefix no shorter than their distance."""
    edges = np.flatnonzero(common >= shortest)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    ends = np.unique(np.concatenate((edges, edges + 1)))
    near = np.searchsorted(ends, edges)
    sets: list[list[int] | None] = [[p] for p in place[order[ends]].tolist()]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found = []
    for at, prefix in zip(near.tolist(), common[edges].tolist(), strict=True):
        a, b = find(at), find(at + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big, small = sets[a], sets[b]
        last = -1
        for k, p in enumerate(small):
            i = bisect(big, p)
            # Neighbours from the same set were looked at when that set was made.
            if i and big[i - 1] > last and p - big[i - 1] <= prefix:
                found.append((big[i - 1], p - big[i - 1], prefix))
            if i < len(big) and (k + 1 == len(small) or small[k + 1] > big[i]) and big[i] - p <= prefix:
                found.append((p, big[i] - p, prefix))
            last = p
        if len(small) * 16 < len(big):
            for p in small:
                insort(big, p)
        else:
            big += small
            big.sort()  # two sorted runs: a merge
        root[b], sets[b] = a, None
    return found


def runs_of(codes: np.ndarray, owner: np.ndarray, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> np.ndarray:
    """Rows ``first word, length, period`` of all texts' runs, in order of first word, then period."""
    shortest = least_common(least, repeats)
    starts = repeated_windows(codes, owner, shortest)
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    symbols, place = compacted(codes, owner, starts, shortest)
    found = np.array(seeds(place, *suffixes(symbols), shortest), np.int64).reshape(-1, 3)
    first, period, length = found[:, 0], found[:, 1], found[:, 1] + found[:, 2]
    before = np.maximum(first - 1, 0)
    goes_on = (first > 0) & (owner[before] == owner[first]) & (codes[before] == codes[before + period])
    keep = (length >= np.maximum(least, repeats * period)) & ~goes_on
    out = np.stack((first, length, period), axis=1)[keep]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _runs(batches: Iterator[pa.RecordBatch], least: int, repeats: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for rows in slices(batch):
            flat, bounds = split_words(rows.column("text"))
            codes = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            runs = runs_of(codes, owner, least, repeats)
            first, length, period = runs.T
            text = owner[first] if len(runs) else np.zeros(0, np.int64)
            marks = np.zeros(len(codes) + 1, np.int64)
            np.add.at(marks, first + period, 1)
            np.add.at(marks, first + length, -1)
            kept = np.cumsum(marks[:-1]) == 0
            left = np.append(0, np.cumsum(kept))[bounds]
            ends = np.append(0, np.cumsum(np.bincount(text, minlength=len(sizes))))
            columns = [pa.array(c) for c in (first - bounds[:-1][text], length, period)]
            listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))
            words = flat if kept.all() else flat.filter(pa.array(kept))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words), " ")
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(sizes), listed, joined], names=["doc_id", "n_words", "runs", "collapsed"]
            )


def periodic_runs(documents: DataFrame, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> DataFrame:
    """Each row's ``n_words``, its ``runs`` and the text ``collapsed`` to one period of each run.

    A run is a stretch of words with smallest period q, at least ``least`` words and
    ``repeats`` (two or more) periods long, that no neighbouring word extends. ``runs``
    come by start, then period. ``collapsed`` has the words outside all runs and those
    in no run but among its first q words, joined by one space.

    A null, empty or blank text has no words, no runs and an empty collapsed text. Each
    input row gives one row, repeated ids and null ids too; other columns are ignored;
    an empty table gives no rows. Memory of a task: about 150 bytes for each word of the
    text at hand that lies in a repeated window.
    """
    if repeats < 2 or least < 1:
        raise ValueError("a run has two periods at least")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _runs(it, least, repeats), RUN_SCHEMA)
