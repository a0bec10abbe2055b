"""Ranked lexical search: the best documents for each item, by exact integer scores.

Documents are vectors of impacts over the items' terms, an item is a vector of weights,
the score is their inner product. Search goes by the length of the vectors, longest
first. Within a task documents lie in buckets of falling length; a bucket whose longest
vector times the item's length (Cauchy-Schwarz) stays below what the item's best
documents have already is passed over. In a bucket the item's largest coordinates are
summed first; the lengths of what is left of both vectors bound the rest, and only
documents whose bound reaches that score are scored, in integers, over all terms.

The longest vectors of the whole table are searched first. What they give is the score
from which all other tasks start, so most of these pass over most of their buckets. Any
document a bound drops has a lower score than enough others: results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import written
from ledgerloom.llm.text import slices, split_words

K = 20
# Items searched in one pass over the documents; a block ends where either number is reached.
BLOCK_ITEMS = 2000
BLOCK_CHARS = 4_000_000
# Share of the documents, those with the longest vectors, that is searched first.
HEAD = 1 / 16
BUCKET = 1024
# Coordinates of an item that are summed before the rest is bounded.
FOCUS = 8
# Bounds are doubles: what lies this little below a score may still reach it.
MARGIN = 1 + 1e-9

COUNT_SCHEMA = "doc_id long, n long, terms array<int>, counts array<int>"
VECTOR_SCHEMA = "doc_id long, square double, terms array<int>, impacts array<int>"
FOUND_SCHEMA = "item long, item_id long, doc_id long, score long"


def _folding() -> bytes:
    """A-Z to a-z, digits and bytes beyond ASCII as they are, any other byte to a space."""
    kept = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
    return bytes(b + 32 * (0x41 <= b <= 0x5A) if b in kept else 0x20 for b in range(256))


FOLDING = _folding()


def term_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and where each text's terms start and end."""
    whole = pa.concat_arrays([pc.fill_null(texts, "")])
    offsets, data = whole.buffers()[1:]
    # Bytes of one character are all beyond ASCII or it is one byte, so bytes can be mapped one by one.
    folded = pa.py_buffer(data.to_pybytes().translate(FOLDING)) if data is not None else data
    return split_words(pa.Array.from_buffers(whole.type, len(whole), [None, offsets, folded]))


def _counted(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    width = max(len(terms), 1)
    for batch in batches:
        for rows in slices(batch):
            flat, bounds = term_lists(rows.column("text"))
            coded = flat.dictionary_encode()
            known = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=terms), -1)).astype(np.int64)
            term = known[np.asarray(coded.indices)]
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            cell, count = np.unique((owner * width + term)[term >= 0], return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(bounds)) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell % width, count)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(bounds)), *lists], names=["doc_id", "n", "terms", "counts"]
            )


class Items:
    """A block of items as sparse integer vectors over the terms that any of them has."""

    def __init__(self, ids: list[int | None], texts: list[str | None], first: int = 0):
        flat, bounds = term_lists(pa.array(texts, pa.string()))
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        self.ids, self.first, self.terms = ids, first, coded.dictionary
        self.vectors = [np.unique(codes[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def weigh(self, weights: np.ndarray) -> None:
        """Keep for each item its terms, integer weights, shares of the length, and lengths of what follows, largest share first.

        Impacts and weights are both scaled by the root of a term's weight: this leaves
        the inner product as it is and takes length from documents full of common terms.
        """
        self.root = np.sqrt(weights)
        self.listed = []
        for terms, count in self.vectors:
            share = count * self.root[terms]
            order = np.argsort(-share, kind="stable")
            after = np.sqrt(np.append(np.cumsum((share[order] ** 2)[::-1])[::-1], 0.0))
            self.listed.append((terms[order], (count * weights[terms])[order], share[order], after))


class Bucket:
    """Impact vectors of some documents, by document and by term."""

    def __init__(self, none: np.ndarray, ids: np.ndarray, squares: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, root: np.ndarray):
        self.none, self.ids, self.squares, self.longest = none, ids, squares, np.sqrt(squares.max())
        self.ends, self.terms, self.impacts = np.append(0, np.cumsum(sizes)), terms, impacts
        order = np.argsort(terms, kind="stable")
        held = terms[order]
        rows, shares = np.repeat(np.arange(len(ids)), sizes)[order], (impacts * root[terms])[order]
        starts = np.flatnonzero(np.append(True, np.diff(held) > 0)) if len(held) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(held))
        self.columns = {
            t: (rows[a:b], shares[a:b]) for t, a, b in zip(held[starts].tolist(), starts.tolist(), ends.tolist(), strict=True)
        }

    def reaching(self, item: tuple[np.ndarray, ...], least: int) -> np.ndarray:
        """Rows that the item's largest coordinates and the lengths of the rest don't rule out."""
        terms, _, share, after = item
        part, rest = np.zeros(len(self.ids)), self.squares.copy()
        focus = min(FOCUS, len(terms))
        for t, s in zip(terms[:focus].tolist(), share[:focus].tolist(), strict=True):
            if t in self.columns:
                rows, held = self.columns[t]
                part[rows] += s * held
                rest[rows] -= held * held
        # What rounding may take from the rest, the margin of the whole square gives back.
        rest = np.sqrt(np.maximum(rest, 0) + self.squares * (MARGIN - 1))
        return np.flatnonzero((part + after[focus] * rest) * MARGIN >= least)

    def scores(self, rows: np.ndarray, item: tuple[np.ndarray, ...]) -> np.ndarray:
        """Exact scores of some rows."""
        by_term = np.argsort(item[0])
        terms, values = item[0][by_term], item[1][by_term]
        sizes = self.ends[rows + 1] - self.ends[rows]
        total = np.append(0, np.cumsum(sizes))
        at = np.arange(total[-1]) + np.repeat(self.ends[rows] - total[:-1], sizes)
        near = np.minimum(np.searchsorted(terms, self.terms[at]), len(terms) - 1)
        products = np.where(terms[near] == self.terms[at], values[near] * self.impacts[at], 0)
        return np.diff(np.append(0, np.cumsum(products))[total])


class Best:
    """Each item's best documents so far: higher score, then smaller id, null ids last."""

    def __init__(self, items: Items, least: np.ndarray, k: int):
        self.items, self.least, self.k = items, least.astype(np.int64), k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items.listed]
        self.scored = 0

    def visit(self, bucket: Bucket) -> None:
        for q, item in enumerate(self.items.listed):
            if not len(item[0]) or bucket.longest * item[3][0] * MARGIN < self.least[q]:
                continue
            rows = bucket.reaching(item, self.least[q])
            if not len(rows):
                continue
            self.scored += len(rows)
            scores = bucket.scores(rows, item)
            reach = scores >= self.least[q]
            more = scores[reach], bucket.none[rows[reach]], bucket.ids[rows[reach]]
            found = [np.concatenate(pair) for pair in zip(self.found[q], more, strict=True)]
            if len(found[0]) >= self.k:
                order = np.lexsort((found[2], found[1], -found[0]))[: self.k]
                found = [x[order] for x in found]
                self.least[q] = max(self.least[q], found[0][-1])
            self.found[q] = tuple(found)


def _vectors(batches: Iterator[pa.RecordBatch], root: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("counts")
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        counts, terms = np.asarray(lists.flatten()).astype(np.int64), np.asarray(batch.column("terms").flatten())
        impacts = (1_000_000_000 * counts) // (1000 * counts + 12 * np.repeat(np.asarray(batch.column("m")), sizes))
        square = np.bincount(np.repeat(np.arange(len(sizes)), sizes), (impacts * root[terms]) ** 2, len(sizes))
        ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(square), *[pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (terms, impacts)]],
            names=["doc_id", "square", "terms", "impacts"],
        )


def _searched(batches: Iterator[pa.RecordBatch], items: Items, least: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(items, least, k)
    for batch in batches:
        for first in range(0, batch.num_rows, BUCKET):
            rows = batch.slice(first, BUCKET)
            lists = rows.column("terms")
            ids = rows.column("doc_id")
            best.visit(
                Bucket(
                    np.asarray(ids.is_null()),
                    np.asarray(pc.fill_null(ids, 0)),
                    np.asarray(rows.column("square")),
                    np.asarray(pc.list_value_length(lists)).astype(np.int64),
                    np.asarray(lists.flatten()).astype(np.int64),
                    np.asarray(rows.column("impacts").flatten()).astype(np.int64),
                    items.root,
                )
            )
    for q, (scores, none, ids) in enumerate(best.found):
        if len(ids):
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([items.first + q] * n), pa.array([items.ids[q]] * n, pa.int64()), pa.array(ids, mask=none), pa.array(scores)],
                names=["item", "item_id", "doc_id", "score"],
            )


def blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size."""
    ids, texts, chars, first = [], [], 0, 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        chars += len(row[1] or "")
        if len(ids) == BLOCK_ITEMS or chars > BLOCK_CHARS:
            yield Items(ids, texts, first)
            ids, texts, chars, first = [], [], 0, first + len(ids)
    if ids:
        yield Items(ids, texts, first)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    terms = items.terms
    counted = written(docs.mapInArrow(lambda it: _counted(it, terms), COUNT_SCHEMA), "term-counts")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs or not len(terms):
        return None
    # A row per term of the block at most.
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(terms), np.int64)
    df[[r[0] for r in held]] = [r[1] for r in held]
    items.weigh(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64))
    root = items.root
    m = F.expr(f"100 - 25 + (25L * n * {n_docs}L) div {n_terms}L").alias("m")
    vectors = counted.where(F.size("terms") > 0).select("doc_id", m, "terms", "counts")
    vectors = vectors.mapInArrow(lambda it: _vectors(it, root), VECTOR_SCHEMA).where(F.col("square") > 0)
    vectors = written(vectors.sortWithinPartitions(F.desc("square")), "impacts")
    cut = vectors.agg(F.percentile_approx("square", 1 - HEAD, 1000)).first()[0]
    if cut is None:
        return None

    def searched(part: DataFrame, least: np.ndarray) -> DataFrame:
        return part.mapInArrow(lambda it: _searched(it, items, least, k), FOUND_SCHEMA)

    least = np.ones(len(items.ids), np.int64)
    head = written(_top(searched(vectors.where(F.col("square") >= cut), least), k), "head")
    for item, score in head.where(F.col("rank") == k).select("item", "score").collect():  # a row per item of the block
        least[item - items.first] = score
    rest = searched(vectors.where(F.col("square") < cut), least)
    return head.drop("rank").unionByName(rest)


def ranked(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of any characters beyond ASCII, A-Z
    lower-cased. A term that ``df`` of the ``N`` documents with any term hold weighs
    ``floor(1000 * ln((2N + 2) / (2 df + 1)))``; a document where it stands ``tf`` times
    among ``n`` terms scores ``weight * (10^9 tf div (1000 tf + 12 m))`` for each time
    the item has it, where ``m`` is ``75 + 25 n N div L`` and ``L`` counts all terms.

    Equal scores rank by id, null ids last. Each row is a document of its own and each
    row of ``items`` an item of its own, repeated and null ids too. Null texts and texts
    without terms match nothing; an empty table on either side gives no rows. Other
    columns are ignored. Items come to the driver in blocks of bounded size, with one
    pass over the documents for each block.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in blocks(items):
        part = _search_block(docs, block, k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], FOUND_SCHEMA)
    return _top(found, k).select("item_id", "rank", "doc_id", "score")
