"""SentencePiece encoding and decoding with a merge-type (BPE) model, exact and without a merge queue.

A sequence of pieces is a text's encoding just if every two neighbours are: merging the
characters of both, best score first and leftmost among equals, must give back the two.
For the merge that would cross a border first, were the sequence wrong, happens between
two neighbours. So the encoder walks from left to right, takes the longest piece that
fits its predecessor, and goes back where none fits. The pieces before a position are
determined by the text before it, so a position that failed has failed for good: a bit
field holds those, and every position is left behind at most once.

No piece has a space mark behind another character, so what lies between two spaces is
encoded on its own, and each distinct stretch once as long as a task remembers it.
Nothing is shuffled; texts are never cut short.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import slices

# Fixed value: the mark that stands for a space in pieces.
SPACE = "▁"

# Distinct stretches, and pairs of pieces, that a task remembers; beyond that it starts afresh.
STRETCHES = 1_000_000
PAIRS = 1_000_000
# Text handled at once: its pieces, as Python numbers for the decoder, take about 20 times as much.
SLICE = 4 << 20

NEVER = 1 << 60
# Neither a letter nor a digit nor a space.
MARK = re.compile(rf"[^\w{SPACE}]")
# Characters that the automaton gets at once.
AHEAD = 64


class PieceEncoder:
    """Pieces of stretches of text by a model file of the library."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.library
        ids = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.ids = {model.id_to_piece(i): i for i in ids}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(model.is_unused(i) for i in range(model.get_piece_size())):
            raise ValueError("only models whose pieces begin with their spaces, and none of them unused, are read")
        # Equal scores share a rank.
        self.ranks = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.width = max(map(len, self.ids))
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.edges: dict[str, tuple[list[str], list[str]]] = {}
        self.whole = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        # The next shorter piece that a piece begins with; its first character in the end.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.whole), p[:1]) for p in self.whole if len(p) > 1}
        self.matches = ahocorasick.Automaton()
        for p in self.whole:
            self.matches.add_word(p, p)
        self.matches.make_automaton()
        self.forget()

    def merged(self, text: str, edges: tuple[list[str], list[str]] | None = None) -> list[str]:
        """The pieces that merging gives: best score first, leftmost among equals. ``edges`` gets the first and last parts on the way."""
        parts, ranks = list(text), self.ranks
        score = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            if edges:
                edges[0].append(parts[0])
                edges[1].append(parts[-1])
            best = min(score, default=NEVER)
            if best == NEVER:
                return parts
            i = score.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del score[i]
            if i:
                score[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
            if i < len(score):
                score[i] = ranks.get(parts[i] + parts[i + 1], NEVER)

    def ends_of(self, piece: str) -> tuple[list[str], list[str]]:
        """All first parts and all last parts that a piece has while it is merged."""
        known = self.edges.get(piece)
        if known is None:
            self.merged(piece, found := ([], []))
            known = list(dict.fromkeys(found[0])), list(dict.fromkeys(found[1]))
            if piece in self.whole:
                self.edges[piece] = known
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when the characters of both are merged anew."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            ranks, firsts = self.ranks, self.ends_of(right)[0]
            # Without a piece across the border no merge can cross it.
            crossed = any(a + b in ranks for a in self.ends_of(left)[1] for b in firsts)
            known = self.pairs[left, right] = not crossed or self.merged(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a stretch; a character that is no piece stands for itself."""
        if text in self.whole:
            return [text]
        n, pairs, shorter = len(text), self.pairs, self.shorter
        failed = bytearray((n >> 3) + 1)
        found: list[str] = []
        at, piece, last, ahead, ready = 0, None, None, None, -1
        while at < n:
            if piece is None:
                if ready != at:  # else the automaton is where the last piece ended
                    ahead, base = self.matches.iter_long(text[at : at + AHEAD]), at
                end, piece = next(ahead, (-1, ""))
                ready = base + end + 1
                if ready > base + AHEAD - self.width and base < at:
                    ready, piece = -1, None  # the text ahead may have cut it short
                    continue
                if ready - len(piece) != at or not piece:
                    ready, piece = -1, text[at]  # nothing begins here, the automaton looked further on
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last is None:
                        break
                    known = pairs.get((last, piece))
                    if self.fits(last, piece) if known is None else known:
                        break
                piece = shorter.get(piece)
            if piece:
                found.append(piece)
                at, last, piece = end, piece, None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = shorter.get(found.pop(), "")
                at, last, ready = at - len(last), found[-1] if found else None, -1
        return found

    def numbers(self, text: str) -> list[int]:
        try:
            return [self.ids[piece] for piece in self.pieces(text)]
        except KeyError:
            out = []
        for piece in self.pieces(text):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes[0] == self.unknown:
                out.append(self.unknown)
            else:
                out += [self.bytes[b] for b in piece.encode()]
        return out

    def cut(self, text: str) -> list[str]:
        """A stretch with marks cut where no piece holds the two characters on either side, so that none can span the border."""
        if not MARK.search(text):
            return [text]
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.joined]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]

    def remembered(self, stretches: list[str]) -> np.ndarray:
        """Where the numbers of each stretch begin and end in ``self.flat``; encodes those not seen yet."""
        if len(self.place) + len(stretches) > STRETCHES:
            self.forget()
        place = self.place
        fresh = {s: self.cut(s) for s in dict.fromkeys(stretches) if s not in place}
        if fresh:
            known: dict[str, list[int]] = {}
            for part in {x for parts in fresh.values() for x in parts}:
                at = place.get(part)
                known[part] = self.numbers(part) if at is None else self.flat[self.ends[at] : self.ends[at + 1]].tolist()
            numbers = {s: known[parts[0]] if len(parts) == 1 else [x for p in parts for x in known[p]] for s, parts in fresh.items()}
            # What begins with a space may come again without the marks behind it.
            numbers |= {p: n for p, n in known.items() if p[0] == SPACE and p not in place}
            sizes = np.fromiter(map(len, numbers.values()), np.int64, len(numbers))
            added = np.fromiter(chain.from_iterable(numbers.values()), np.int32, int(sizes.sum()))
            self.flat = np.concatenate((self.flat, added))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
            place.update(zip(numbers, range(len(place), len(place) + len(numbers)), strict=True))
        return np.array([place[s] for s in stretches], np.int64)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the texts in order, and where each text's numbers start and end."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        parts, bounds = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        bounds -= bounds[0]
        # A space stands before every part; those before empty parts go to the next part, or end the text.
        holds = np.asarray(pc.greater(pc.binary_length(parts), 0))
        holds[bounds[1:] - 1] = True
        holds[bounds[:-1][np.asarray(pc.equal(pc.binary_length(texts), 0))]] = False
        at = np.flatnonzero(holds)
        text = np.searchsorted(bounds, at, side="right") - 1
        spaces = at - np.maximum(np.append(-1, at[:-1])[: len(at)], bounds[text] - 1)
        coded = parts.take(pa.array(at)).dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        n = len(coded.dictionary)
        distinct, where = np.unique(codes + n * (spaces - 1), return_inverse=True)
        words = coded.dictionary.to_pylist()
        place = self.remembered([SPACE * (k // n + 1) + words[k % n] for k in distinct.tolist()])[where]
        starts, sizes = self.ends[:-1][place], np.diff(self.ends)[place]
        total = np.append(0, np.cumsum(sizes))
        take = np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
        return self.flat[take], total[np.searchsorted(at, bounds)]


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    return _encoders.get(path) or _encoders.setdefault(path, PieceEncoder(path))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for batch in batches:
        for rows in slices(batch, most=SLICE):
            gc.disable()  # many small lists, no cycles: looking for some takes a fifth of the time
            ids, ends = encoder.encode(rows.column("text"))
            gc.enable()
            columns = [rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
            if decoded:
                numbers = ids.tolist()
                lists = [numbers[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns.append(pa.array(encoder.library.decode(lists, num_threads=1), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    library = _encoder(path).library
    for batch in batches:
        texts = [library.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])


def encode(documents: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """Each row's ``doc_id`` and ``ids array<int>``, just as the library encodes its text; on request ``decoded``, their text.

    ``model`` is the path of a merge-type model file that every executor has; begin and
    end ids are not added. A null or empty text has no ids and decodes to an empty text.
    Each input row gives one row, repeated ids and null ids too; other columns are
    ignored; an empty table gives no rows. A mark of a space in the text counts as a
    space. Characters without a piece become the ids of their bytes, or the unknown id.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, ids array<int>" + (", decoded string" if decoded else "")
    return rows.mapInArrow(lambda it: _encoded(it, model, decoded), schema)


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """The text of each row's ``ids`` as ``doc_id, decoded``; null or no ids give an empty text."""
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda it: _decoded(it, model), "doc_id long, decoded string")
