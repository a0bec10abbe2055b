"""Substring dedup: long word spans that an earlier document already holds.

A window of ``width`` words is an edge of the De Bruijn graph of the corpus (its
nodes are the windows' word k-mers). Edges are not shuffled one by one. Each
window has an anchor, its ``k``-word run with the smallest hash; neighbouring
windows with one anchor form a span, and a span is the unit that is shuffled
(about one row per ``(width - k + 2) / 2`` words). Equal windows have equal
anchors, so anchors seen in one document only are done.

An anchor with one span everywhere is an unbranched path: all its windows repeat
together and one join settles them. An anchor with several spans branches; each
distinct span is settled for all documents but its first, and only that first
one is cut into single windows, which are joined by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import written
from ledgerloom.llm.text import hashed, mixed, slices, split_words

WIDTH, ANCHOR = 50, 16
SPAN_SCHEMA = "doc_id long, tag long, start long, windows int, anchor long, span long, check long"
WINDOW_SCHEMA = "doc_id long, tag long, start long, digest long, check long"
KEPT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"

# An odd base (so that it has an inverse modulo 2**64) and second-hash seed.
BASE = 0x9E3779B97F4A7C15 | 1
SECOND = np.uint64(0xD6E8FEB86659FD93)


class _Sums:
    """Prefix sums that give the digest of any run of words of a slice."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, words: np.ndarray):
        up, self.down = self.powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:-1], out=self.sums[1:])

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            made = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
            cls._powers = tuple(made)
        return cls._powers[0][:n], cls._powers[1][:n]

    def digest(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its first smallest one."""
    best, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        reach += step
    return best


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _spans(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            flat, bounds = split_words(part.column("text"))
            sizes = np.diff(bounds)
            fit = np.maximum(sizes - width + 1, 0)
            if not fit.any():
                continue
            first = hashed(flat)
            one, two = _Sums(first), _Sums(mixed(first ^ SECOND))
            grams = mixed(one.digest(np.arange(len(first) - k + 1), k))
            anchor = _leftmost_min(grams, width - k + 1)
            # Windows that lie inside one document, and the document of each.
            owner = np.repeat(np.arange(len(sizes)), fit)
            window = np.arange(len(owner)) - np.repeat(np.cumsum(fit) - fit, fit) + bounds[:-1][owner]
            at = anchor[window]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
            heads = np.flatnonzero(new)
            count = np.diff(np.append(heads, len(at)))
            start, at, owner = window[heads], at[heads], owner[heads]
            length = count + width - 1
            form = (length * 64 + (at - start)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(owner)),
                    part.column("tag").take(pa.array(owner)),
                    pa.array(start - bounds[:-1][owner]),
                    pa.array(count.astype(np.int32)),
                    _signed(grams[at]),
                    _signed(mixed(one.digest(start, length) + mixed(form))),
                    _signed(mixed(two.digest(start, length) + mixed(form))),
                ],
                names=["doc_id", "tag", "start", "windows", "anchor", "span", "check"],
            )


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each wanted window of a document with its digest; ``wanted`` lists (start, windows)."""
    for batch in batches:
        for part in slices(batch):
            flat, bounds = split_words(part.column("text"))
            first = hashed(flat)
            one, two = _Sums(first), _Sums(mixed(first ^ SECOND))
            wanted = part.column("wanted")
            per = np.diff(np.asarray(wanted.offsets))
            runs = wanted.flatten()
            begin = np.asarray(runs.field("start")).astype(np.int64)
            count = np.asarray(runs.field("windows")).astype(np.int64)
            doc = np.repeat(np.arange(len(per)), per)
            owner = np.repeat(doc, count)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(begin, count) + inner
            where = start + bounds[:-1][owner]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(owner)),
                    part.column("tag").take(pa.array(owner)),
                    pa.array(start),
                    _signed(one.digest(where, width)),
                    _signed(two.digest(where, width)),
                ],
                names=["doc_id", "tag", "start", "digest", "check"],
            )


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows: list[tuple] = []
            texts, gone = part.column("text"), part.column("gone")
            for text, ranges in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
                parts = (text or "").encode().split()
                kept, at, removed = [], 0, 0
                for run in sorted((r["start"], r["end"]) for r in ranges or ()):
                    begin, end = max(run[0], at), run[1]
                    if end > at:
                        kept += parts[at:begin]
                        removed += end - begin
                        at = end
                kept = b" ".join(kept + parts[at:])
                rows.append((len(parts), removed, kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest()))
            n, removed, kept, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(digest),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )


def removed_ranges(documents: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """``doc_id, tag, start, end``: word ranges that documents with a smaller id hold too.

    ``documents`` has ``doc_id, tag, text`` without null ids. Ranges may overlap.
    """
    found = documents.select("doc_id", "tag", "text").mapInArrow(lambda it: _spans(it, width, k), SPAN_SCHEMA)
    spans = written(found, "spans")
    anchors = spans.groupBy("anchor").agg(
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        ((F.min("span") == F.max("span")) & (F.min("check") == F.max("check"))).alias("unbranched"),
    )
    # Written before they are joined, so that the join can split an anchor with very many spans.
    anchors = written(anchors.where("first_doc < last_doc").drop("last_doc"), "anchors")
    shared = written(spans.join(anchors, "anchor"), "shared-spans")
    run = (F.col("start"), (F.col("start") + F.col("windows") + width - 1).alias("end"))
    plain = shared.where("unbranched and doc_id > first_doc").select("doc_id", "tag", *run)

    kinds = ["anchor", "span", "check"]
    branched = shared.where("not unbranched")
    firsts = written(branched.groupBy(*kinds).agg(F.min("doc_id").alias("holder")), "first-spans")
    classed = branched.join(firsts, kinds)
    repeated = classed.where("doc_id > holder").select("doc_id", "tag", *run)

    wanted = (
        classed.where("doc_id = holder")
        .groupBy("doc_id", "tag")
        .agg(F.collect_set(F.struct("start", "windows")).alias("wanted"))
    )
    single = written(
        documents.join(wanted, ["doc_id", "tag"])
        .select("doc_id", "tag", "text", "wanted")
        .mapInArrow(lambda it: _windows(it, width), WINDOW_SCHEMA),
        "windows",
    )
    earliest = single.groupBy("digest", "check").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"))
    earliest = written(earliest.where("holder < last").drop("last"), "first-windows")
    alone = (
        single.join(earliest, ["digest", "check"])
        .where("doc_id > holder")
        .select("doc_id", "tag", "start", (F.col("start") + width).alias("end"))
    )
    return plain.union(repeated).union(alone)


def substring_dedup(documents: DataFrame, width: int = WIDTH, k: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_text, kept_sha256``.

    A word goes if a window of ``width`` words around it also starts in a document
    with a smaller ``doc_id``; windows are those of the input. Null or empty texts
    have no words and keep nothing; shorter texts than ``width`` keep everything.
    Rows with a null ``doc_id`` neither lose words nor make others lose any. Rows
    that share an id are not smaller than each other. Further columns are ignored;
    an empty table gives no rows. ``kept_text`` is null unless ``with_text``.
    """
    known = documents.where("doc_id is not null").select(
        F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text"
    )
    ranges = (
        removed_ranges(known, width, k)
        .groupBy("doc_id", "tag")
        .agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    )
    nameless = documents.where("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("gone")
    )
    both = known.join(ranges, ["doc_id", "tag"], "left").select("doc_id", "text", "gone").union(nameless)
    return both.mapInArrow(lambda it: _cut(it, with_text), KEPT_SCHEMA)
