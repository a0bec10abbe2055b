"""Packing: token streams joined end to end and cut into fixed windows.

The first pass tokenizes each document once and writes its ids together with the
tokens before it in its task. The second pass adds the totals of the tasks before
(one number per task), which gives every document its place in one global stream,
and cuts it at multiples of the window; a document that crosses a boundary leaves
one record on either side. No rows are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import written
from ledgerloom.llm.text import slices, split_words

WINDOW = 4096
END_ID = 2
# Distinct word pieces a task keeps encoded; beyond that it starts afresh.
CACHE = 600_000
# Text handled at once; its words, their ids and indices take many times its size.
SLICE = 1 << 21

TOKEN_SCHEMA = "part int, before long, doc_id long, doc_tokens long, ids binary"
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)

# A run of letters and the ASCII marks after it, which the tokenizer never joins.
PARTS = r"^(?P<word>\pL+)(?P<tail>[!-/:-@\[-`{-~]*)$"
# Letters that are composed already and whose lower case is one such letter; and that lower case.
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
SIMPLE = r"^[a-zß-öø-ÿ]+$"


class WordEncoder:
    """Ids of texts by a tokenizer that splits at white space, each distinct word encoded once.

    The tokenizer's normalizer and pre-tokenizer never look across white space, nor
    from a run of letters into the marks after it, so a text's ids are those of its
    pieces in order. Plain words go straight to the tokenizer's model, in the byte
    alphabet its pre-tokenizer would produce; all others take its whole path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.clear()

    def clear(self) -> None:
        self.place = {"": 0}
        self.ids = np.zeros(1 << 16, self.width)
        self.used = 0
        self.starts, self.sizes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]

    def _encode(self, words: list[str], simple: list[bool]) -> list[list[int]]:
        model = self.tokenizer.model.tokenize
        whole = iter(
            self.tokenizer.encode_batch_fast([w for w, s in zip(words, simple, strict=True) if not s], add_special_tokens=False)
        )
        out = []
        for word, plain in zip(words, simple, strict=True):
            if not plain:
                out.append(next(whole).ids)
            elif word.isascii():
                out.append([t.id for t in model(word)])
            else:
                out.append([t.id for t in model(word.encode().decode("latin-1").translate(self.alphabet))])
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of each distinct piece are; encodes those not seen yet."""
        texts = pieces.to_pylist()
        fresh = [i for i, t in enumerate(texts) if t not in self.place]
        if fresh:
            simple = np.asarray(pc.match_substring_regex(pieces, SIMPLE)).tolist()
            found = self._encode([texts[i] for i in fresh], [simple[i] for i in fresh])
            sizes = np.array([len(x) for x in found], np.int64)
            flat = np.fromiter((y for x in found for y in x), self.width, int(sizes.sum()))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
            self.ids[self.used : self.used + len(flat)] = flat
            starts = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            first = len(self.place)
            for j, i in enumerate(fresh):
                self.place[texts[i]] = first + j
            self.starts, self.sizes = [np.concatenate([*self.starts, starts])], [np.concatenate([*self.sizes, sizes])]
        place = self.place
        return np.array([place[t] for t in texts], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids start and end."""
        if len(self.place) > CACHE:
            self.clear()
        flat, bounds = split_words(texts)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        parts = pc.extract_regex(distinct, PARTS)
        split = np.asarray(parts.is_valid())
        # Other words keep their case: lowering them is the tokenizer's business.
        whole = parts.field("word")
        lower = pc.if_else(pc.match_substring_regex(whole, PLAIN), pc.utf8_lower(whole), whole)
        word = pc.if_else(pa.array(split), lower, distinct)
        tail = pc.if_else(pa.array(split), parts.field("tail"), "")
        pairs = np.empty((len(distinct), 2), np.int64)
        for column, pieces in enumerate((word, tail)):
            own = pieces.dictionary_encode()
            pairs[:, column] = self._places(own.dictionary)[np.asarray(own.indices)]
        index = pairs[np.asarray(coded.indices)].ravel()
        sizes, starts = self.sizes[0][index], self.starts[0][index]
        total = np.append(0, np.cumsum(sizes))
        take = np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[take], total[2 * bounds]


_encoders: dict[str, WordEncoder] = {}


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in slices(batch, most=SLICE):
            ids, bounds = encoder.encode(rows.column("text"))
            stop = np.array([end], encoder.width).tobytes()
            sizes = np.diff(bounds) + 1
            held = [ids[a:b].tobytes() + stop for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sizes), part, np.int32)),
                    pa.array(before + np.cumsum(sizes) - sizes),
                    rows.column("doc_id"),
                    pa.array(sizes),
                    pa.array(held, pa.binary()),
                ],
                names=["part", "before", "doc_id", "doc_tokens", "ids"],
            )
            before += int(sizes.sum())
    # The process outlives the task; what it keeps is missing elsewhere.
    encoder.clear()


def _pieces(batches: Iterator[pa.RecordBatch], window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "ids", SLICE):
            first = np.asarray(rows.column("first"))
            sizes = np.asarray(rows.column("doc_tokens"))
            n = (first + sizes - 1) // window - first // window + 1
            owner = np.repeat(np.arange(len(n)), n)
            sequence = first[owner] // window + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.maximum(sequence * window, first[owner])
            stop = np.minimum((sequence + 1) * window, first[owner] + sizes[owner])
            start, length = begin - first[owner], stop - begin
            held = rows.column("ids").to_pylist()
            wide = np.concatenate(
                [np.frombuffer(x, np.uint16 if len(x) == 2 * k else np.uint32) for x, k in zip(held, sizes.tolist(), strict=True)]
            ).astype("<u4")
            base = (np.cumsum(sizes) - sizes)[owner] + start
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(base.tolist(), (base + length).tolist(), strict=True)]
            take = rows.column("doc_id").take(pa.array(owner))
            columns = [take, start, length, np.array(crc, np.int64), sizes[owner], sequence, begin - sequence * window]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.append(0, np.cumsum(length)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(wide.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)


def pack(
    documents: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of documents laid out gaplessly in sequences of ``window`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked
    for, ``ids array<int>``. ``tokenizer`` is the path of a tokenizer file that every
    executor has. A document's stream is its ids and ``end``; a null or empty text has
    only ``end``. Every sequence but the last is full, so padding is below one window
    for the whole table. Each input row is packed, repeated ids and null ids too; other
    columns are ignored; an empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = written(rows.mapInArrow(lambda it: _tokenized(it, tokenizer, end), TOKEN_SCHEMA), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    # One row per task of the first pass, whatever the size of the table.
    placed = tokens.join(F.broadcast(bases), "part")
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    ready = placed.select("doc_id", (F.col("base") + F.col("before")).alias("first"), "doc_tokens", "ids")
    return ready.mapInArrow(lambda it: _pieces(it, window, with_ids), schema)
