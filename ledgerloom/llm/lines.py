"""Line dedup: near-equal lines of the whole corpus, of which one stays.

Lines are lower-cased and their white space folded; equal ones are one node. Nodes get
MinHash signatures over character shingles. Lines of few distinct shingles take one
minimum per hash function, long ones one minimum per bin of a single hash; those in
between take both, so any two lines that can be similar share a scheme. Signatures are cut into
bands; nodes that share a band are compared by exact Jaccard similarity of their shingles.

Within a band's bucket not all pairs are compared: first every node with the most
frequent one, then, once links have been joined into components, only nodes of
different components whose sketches (``sketch``) allow the similarity; neither leaves out
a pair that could link two components. Texts are joined to what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.components import components
from ledgerloom.llm.sieve import Sieve, sieve
from ledgerloom.llm.sketch import MAPS, SKETCH, may_be_similar, sketches
from ledgerloom.llm.store import scratch, written
from ledgerloom.llm.text import mixed, slices, texts_of

SHINGLE, SIMILAR = 7, 0.8
BANDS, ROWS = 9, 4
# Shingles from which a line has a long signature, and up to which it has a short one.
LONG, SHORT = 128, 200
# Text handled at once; small, as about twenty bytes of arrays go with each character.
SLICE = 1 << 20
# Characters whose signatures are worked out at once: their arrays stay in a processor's cache.
BLOCK = 1 << 17
# Band keys of a task that looks for shared ones.
PART = 1 << 19
# Nodes of a bucket that meet as many others in one task; larger buckets are cut into parts.
AT_ONCE = 1 << 12

LINE_SCHEMA = "id long, tag string, line int, node long, bands array<long>"
NAMELESS = (1 << 63) - 1
SKETCHED = ("size", *MAPS)

_STEP = np.uint64(0x9DDFEA08EB382D69)
_NONE = ~np.uint64(0)
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


# Runs of spaces and white space other than spaces and line feeds; most texts have none.
_GAPS = ("  ", *[c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"])


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """``normal`` of each line of a text."""
    text = text.lower()
    if any(gap in text for gap in _GAPS):
        return [" ".join(x.split()) for x in text.split("\n")]
    return [x.strip(" ") for x in text.split("\n")]


def node_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def shingles(text: str) -> set[str]:
    """Character shingles of a normalised line; a shorter line is its own one."""
    return {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


def _runs(texts: list[str], size: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of lines that have ``size`` of them, one at least, repeats included."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    # Runs of 1, 2, 4, 6 and at last SHINGLE = 7 characters.
    two = codes[:-1] * _STEP
    two += codes[1:]
    run = two[:-2] * _STEP**2
    run += two[2:]
    run = run[:-2] * _STEP**2
    run += two[4:]
    run = run[:-1] * _STEP
    run += codes[6:]
    return mixed(run[_inside(size)[: len(run)]])


def _inside(size: np.ndarray) -> np.ndarray:
    """Whether a shingle of its own line starts at each character of lines that have ``size`` of them."""
    ends = np.cumsum(size + SHINGLE - 1)
    inside = np.ones(ends[-1], bool)
    inside[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    return inside


def signatures(texts: list[str]) -> list[np.ndarray]:
    """Band keys of each normalised line; none for lines that only equal lines can be similar to."""
    number, keys = _banded(texts)
    return np.split(keys, np.cumsum(number)[:-1]) if texts else []


def _banded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many band keys each normalised line has, and all of these line by line."""
    owner, keys = [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.int64)]
    sizes = np.array([len(t) - SHINGLE + 1 for t in texts], np.int64)
    for chosen in (np.flatnonzero((sizes > 0) & (sizes < LONG)), np.flatnonzero(sizes >= LONG)):
        block = np.cumsum(sizes[chosen]) // BLOCK
        for rows in np.split(chosen, np.flatnonzero(np.diff(block)) + 1):
            if len(rows):
                for lines, own in _signatures([texts[i] for i in rows], sizes[rows]):
                    owner.append(rows[lines])
                    keys.append(own)
    at = np.concatenate(owner)
    return np.bincount(at, minlength=len(texts)) * BANDS, np.concatenate(keys)[np.argsort(at, kind="stable")].ravel()


def _signatures(texts: list[str], size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lines and their ``BANDS`` keys by each scheme they take; lines have ``size`` shingles each, one at least."""
    hashed = _runs(texts, size)
    start = np.cumsum(size) - size
    keys = []
    long = np.flatnonzero(size >= LONG)
    # Hashes of the long lines, and the line of each.
    x = hashed if len(long) == len(size) else hashed[np.repeat(size >= LONG, size)]
    line = np.repeat(np.arange(len(long)), size[long])
    short = np.flatnonzero(_few(x, line, long, size))
    if len(short):
        own = [hashed[start[i] : start[i] + size[i]] for i in short]
        own = [y if len(y) <= 2 * SHORT else np.unique(y) for y in own]  # repeats only cost time
        y, first = np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1]
        y = y ^ (y >> np.uint64(29))
        minima = np.stack([np.minimum.reduceat(y * f, first) for f in _FACTORS], axis=1)
        keys.append((short, _folded(minima, 0)))
    if len(long):
        width = BANDS * ROWS
        minima = np.full(len(long) * width, _NONE)
        np.minimum.at(minima, line * width + ((x >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).view(np.int64), x)
        minima = minima.reshape(-1, width)
        empty = minima == _NONE
        while empty.any():  # an empty bin takes the next full one's value, marked by the distance
            following = np.roll(minima, -1, axis=1)
            minima = np.where(empty & ~np.roll(empty, -1, axis=1), following + _STEP, minima)
            empty = minima == _NONE
        keys.append((long, _folded(minima, 1)))
    return keys


def _few(x: np.ndarray, line: np.ndarray, long: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lines that have up to ``SHORT`` distinct shingles, and a few that have somewhat more.

    ``x`` are the hashes of the ``long`` lines. A repetitive line has fewer distinct ones
    than places; they fill at most as many bins.
    """
    few = size <= SHORT
    filled = np.zeros(len(long) << 10, bool)
    filled[(line << 10) + (x & np.uint64(1023)).view(np.int64)] = True
    few[long] |= filled.reshape(len(long), 1 << 10).sum(axis=1) <= SHORT
    return few


def _folded(minima: np.ndarray, scheme: int) -> np.ndarray:
    folded = np.zeros((len(minima), BANDS), np.uint64) + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1 + scheme * BANDS)) * _STEP
    grouped = minima.reshape(len(minima), BANDS, ROWS)
    for j in range(ROWS):
        folded = mixed(folded * _STEP + grouped[:, :, j])
    return folded.view(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SLICE):
            listed = [normal_lines(text) for text in texts_of(part)]
            per = np.array([len(x) for x in listed], np.int64)
            filled = np.array([bool(x) for own in listed for x in own], bool)
            if not filled.any():
                continue
            doc = np.repeat(np.arange(len(per)), per)[filled]
            line = (np.arange(len(filled)) - np.repeat(np.cumsum(per) - per, per))[filled]
            distinct: dict[str, int] = {}
            index = np.array([distinct.setdefault(x, len(distinct)) for own in listed for x in own if x])
            nodes = np.array([node_of(t) for t in distinct], np.int64)
            # Only a text's first line in the slice carries its bands; such lines follow each other as ``distinct`` does.
            first = np.zeros(len(index), bool)
            first[np.unique(index, return_index=True)[1]] = True
            number, keys = _banded(list(distinct))
            ends = np.cumsum(np.where(first, number[index], 0), dtype=np.int32)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys), mask=pa.array(~first))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(take),
                    part.column("tag").take(take),
                    pa.array(line, pa.int32()),
                    pa.array(nodes[index]),
                    bands,
                ],
                names=["id", "tag", "line", "node", "bands"],
            )


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Band keys and their nodes, dealt over ``parts`` by key: rows of many keys, as each key is a short row of its own otherwise."""
    key, node, held = [], [], 0
    for batch in batches:
        bands = batch.column("bands")
        per = np.asarray(pc.fill_null(pc.list_value_length(bands), 0))
        key.append(np.asarray(bands.flatten()))
        node.append(np.repeat(np.asarray(batch.column("node")), per))
        held += len(key[-1])
        if held >= PART:
            yield _by_part(np.concatenate(key), np.concatenate(node), parts)
            key, node, held = [], [], 0
    if held:
        yield _by_part(np.concatenate(key), np.concatenate(node), parts)


def _by_part(key: np.ndarray, node: np.ndarray, parts: int) -> pa.RecordBatch:
    part = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))[:-1]
    columns = [pa.array([x.tobytes() for x in np.split(column[order], ends)], pa.binary()) for column in (key, node)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), *columns], names=["part", "keys", "nodes"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, node, n`` of keys that several nodes have; a node's ``n`` under a key may come in several rows to add up.

    All rows of a key are in one task, which holds a row per key: its node and number, as
    long as that is the only one. Nodes of a key that has several are passed on at once.
    """
    held, several = np.zeros((3, 0), np.int64), np.zeros(0, bool)
    for batch in batches:
        key, node = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("keys", "nodes"))
        if not len(key):
            continue
        rows = np.concatenate((held, np.stack((key, node, np.ones_like(key)))), axis=1)
        several = np.concatenate((several, np.zeros(len(key), bool)))
        order = np.argsort(rows[0])
        same = rows[0, order[1:]] == rows[0, order[:-1]]
        # Few keys have several rows; only these are put in order of their nodes.
        some = np.flatnonzero(np.append(same, False) | np.append(False, same))
        order[some] = order[some][np.lexsort((rows[1, order[some]], rows[0, order[some]]))]
        rows, several = rows[:, order], several[order]
        starts = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
        n = np.add.reduceat(rows[2], starts)
        key, node = rows[:2, starts]
        several = np.logical_or.reduceat(several, starts)
        # Now a row per key and node; of these the first of each key.
        firsts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        nodes = np.diff(np.append(firsts, len(key)))
        shared = np.logical_or.reduceat(several, firsts) | (nodes > 1)
        keep = np.repeat(shared, nodes) & (n > 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, n)], names=["key", "node", "n"])
        # What is passed on counts no more.
        held, several = np.stack((key[firsts], node[firsts], np.where(shared, 0, n[firsts]))), shared


def _texts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Normalised lines whose node may be wanted."""
    may: Sieve = shared.value
    for batch in batches:
        for part in slices(batch, most=SLICE):
            distinct = list({x for text in texts_of(part) for x in normal_lines(text) if x})
            nodes = np.array([node_of(t) for t in distinct], np.int64)
            keep = np.flatnonzero(may(nodes)) if len(nodes) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[keep]), pa.array([distinct[i] for i in keep], pa.string())], names=["node", "text"]
            )


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SLICE):
            texts = texts_of(part)
            size = np.array([len(t) - SHINGLE + 1 for t in texts], np.int64)
            columns = sketches(_runs(texts, size), size) if len(texts) else sketches(np.zeros(0, np.uint64), size)
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("text"), *columns], names=["node", "text", "size", *MAPS])


def _compared(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "b_text", SLICE):
            # Pairs come sorted by ``a``: runs of equal texts are worked out once.
            ones, others = part.column("a_text").to_pylist(), part.column("b_text").to_pylist()
            at = np.cumsum([a != last for a, last in zip(ones, [None, *ones], strict=False)]) - 1
            firsts = [ones[i] for i in np.unique(at, return_index=True)[1].tolist()]
            known = _shingled(firsts + others)
            keep = [_similar(known[i], other, similar) for i, other in zip(at.tolist(), known[len(firsts) :], strict=True)]
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(chosen), part.column("b").filter(chosen)], names=["a", "b"])


def _shingled(texts: list[str]) -> list[tuple[str, np.ndarray | None]]:
    """Each text with the numbers of its distinct shingles in order.

    A number holds all characters of its shingle, nine bits each, so equal ones mean equal
    shingles among these texts. It is left out (None) for texts of less than a shingle, or with characters that
    come after the first 512 of these texts.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    held = np.zeros(int(codes.max(initial=0)) + 1, bool)
    held[codes] = True
    place = np.cumsum(held)[codes] - 1
    run = place[: 1 - SHINGLE] & 511
    for i in range(1, SHINGLE):
        run = run << 9 | place[i : len(run) + i] & 511
    ends = np.cumsum([len(t) for t in texts]).tolist()
    out = []
    for text, end in zip(texts, ends, strict=True):
        start = end - len(text)
        fits = len(text) >= SHINGLE and place[start:end].max() < 512
        out.append((text, _distinct(run[start : end - SHINGLE + 1]) if fits else None))
    return out


def _distinct(numbers: np.ndarray) -> np.ndarray:
    ordered = np.sort(numbers)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]


def _similar(one: tuple[str, np.ndarray | None], other: tuple[str, np.ndarray | None], similar: float) -> bool:
    """Whether the Jaccard similarity of the shingles of two texts is ``similar`` or more."""
    if one[1] is None or other[1] is None:
        a, b = shingles(one[0]), shingles(other[0])
        both = len(a & b)
    else:
        a, b = one[1], other[1]
        merged = np.sort(np.concatenate((a, b)), kind="stable")
        both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return both >= similar * (len(a) + len(b) - both)


def similar_lines(lines: DataFrame, documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``node, root`` of nodes that are linked to others, from the table of lines and the texts."""
    spark = lines.sparkSession
    rows = lines.where("bands is not null").select("node", "bands")
    parts = 1 + lines.count() * BANDS // PART
    dealt = rows.mapInArrow(lambda it: _dealt(it, parts), "part int, keys binary, nodes binary").repartition(parts, "part")
    # Bands come once a slice, so ``n`` counts the slices of text that hold the line.
    met = dealt.mapInArrow(_shared, "key long, node long, n long")
    members = written(met.groupBy("key", "node").agg(F.sum("n").alias("n")), "line-members")

    wanted = written(members.select("node").distinct(), "line-wanted")
    also = spark.sparkContext.broadcast(sieve(wanted, "node"))
    found = documents.select("text").mapInArrow(lambda it: _texts(it, also), "node long, text string")
    texts = found.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sketched = texts.mapInArrow(_sketched, f"node long, text string, {SKETCH}")
    return joined_groups(members, written(sketched, "line-texts"), lambda it: _compared(it, similar), similar)


def joined_groups(
    members: DataFrame,
    texts: DataFrame,
    compared: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    similar: float,
    known: DataFrame | None = None,
) -> DataFrame:
    """``node, root`` of nodes that are linked to others: those under one ``key`` of ``members``
    (``key, node, n``) whose ``texts`` (``node, text`` and the columns of a sketch) pass
    ``compared``, which asks for a similarity of ``similar``, and those that ``known`` (``a, b``) links.

    A node is a member of many buckets, so sketches are joined to pairs and to the buckets
    that still hold several components, never to all members.
    """
    sketches_a = texts.select("node", *SKETCHED)
    sketches_b = texts.select(*[F.col(c).alias(f"other_{c}") for c in ("node", *SKETCHED)])

    def linked(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
        met = pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text")
        return met.mapInArrow(compared, "a long, b long")

    # The line that occurs most often is likely the one that the others were made from.
    centres = members.groupBy("key").agg(F.max_by("node", "n").alias("other_node"))
    others = written(members.join(centres, "key").where("node != other_node").select("key", "node", "other_node"), "members")
    met = others.select("node", "other_node").distinct().join(sketches_a, "node").join(sketches_b, "other_node")
    links = written(linked(written(_pairs(met.where(may_be_similar(similar))), "pairs")), "links")
    links = links if known is None else links.union(known)
    groups = components(links)
    across = written(_across(others.select("key", "node"), sketches_a, groups, similar), "pairs")
    more = written(linked(across), "links")
    return groups if more.isEmpty() else components(links.union(more))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()


def _across(others: DataFrame, sketched: DataFrame, groups: DataFrame, similar: float) -> DataFrame:
    """Pairs of nodes that share a bucket but no component and may be similar.

    ``others`` are the members but for each bucket's centre, which has met everybody. A
    node outside the largest component of these meets all those of other components.
    Buckets with many such meetings are cut both ways into ``parts``, so that no task
    makes many more than the square of ``AT_ONCE`` for one part.
    """
    rooted = others.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted")
    per_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    top = F.max_by("root", "n").alias("top")
    per_key = per_root.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("all"), F.max("n").alias("most"), top).where("roots > 1")
    parts = F.ceil(F.sqrt((F.col("all") - F.col("most")) * F.col("all")) / AT_ONCE).cast("int")
    mixed_keys = per_key.select("key", "top", parts.alias("parts"))
    here = written(rooted.join(mixed_keys, "key").join(sketched, "node"), "mixed")
    own, each = F.pmod(F.xxhash64("node"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    minor = here.where("root != top").withColumn("x", own).withColumn("y", each).drop("parts")
    met = here.withColumn("y", own).withColumn("x", each).drop("parts", "top")
    met = met.select("key", "x", "y", *[F.col(c).alias(f"other_{c}") for c in ("node", "root", *SKETCHED)])
    # Two nodes that are both outside the largest component meet once.
    once = (F.col("other_root") == F.col("top")) | (F.col("node") < F.col("other_node"))
    apart = F.col("root") != F.col("other_root")
    same = [minor[c] == met[c] for c in ("key", "x", "y")]
    return _pairs(minor.join(met, [*same, apart & once & may_be_similar(similar)]))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SLICE):
            rows = []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                out = set(gone or ())
                left = "\n".join(x for j, x in enumerate(lines) if j not in out)
                filled = sum(1 for x in lines if x.strip())
                # A text that loses nothing stays as it is, null included.
                rows.append((left if out else text, filled, len(out), hashlib.sha256(left.encode()).hexdigest()))
            text, n, removed, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                names=["row", "kept_text", "n_lines", "n_removed", "kept_sha256"],
            )


def line_dedup(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per input row: ``row`` (its other columns), ``kept_text, n_lines, n_removed, kept_sha256``.

    Lines end at line feeds; blank ones (``str.strip`` leaves nothing) are not counted and
    stay. Of all lines that similarity links, one stays: the one with the smallest
    ``doc_id``, null ids last, and the first of those in its text. Two lines are similar if
    the Jaccard similarity of their sets of character shingles is ``similar`` or more; a
    line shorter than a shingle is only similar to equal ones. A text that loses nothing is
    unchanged, a null text stays null. Rows with the same id and text are one document and
    lose the same lines. Further columns are kept; an empty table gives no rows.
    """
    named = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)).alias("id"),
        # Texts under one id, or without one, are told apart by 128 bits; those without come last.
        F.concat(F.when(F.col("doc_id").isNull(), "~").otherwise(""), F.md5(F.coalesce("text", F.lit("")))).alias("tag"),
        "text",
        F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("row"),
    )
    with scratch(documents.sparkSession):
        lines = written(named.select("id", "tag", "text").mapInArrow(_lines, LINE_SCHEMA), "lines")
        places = written(_gone(lines, documents, similar), "line-gone", outlives=True)
    # A document's lines are few beside its text, which a hash join needs not sort.
    gone = places.groupBy("id", "tag").agg(F.collect_set("line").alias("gone")).hint("shuffle_hash")
    schema = T.StructType([named.schema["row"]]).add("kept_text", T.StringType())
    schema = schema.add("n_lines", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType())
    joined = named.join(gone, ["id", "tag"], "left").select("row", "text", "gone")
    return joined.mapInArrow(_kept, schema)


def _gone(lines: DataFrame, documents: DataFrame, similar: float) -> DataFrame:
    """``id, tag, line`` of the lines that have to give way to another."""
    groups = similar_lines(lines, documents, similar)
    # Most lines occur once and are like no other; only the rest need their places compared.
    repeated = lines.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    rooted = repeated.join(groups, "node", "full").select("node", F.coalesce("root", "node").alias("root"))
    placed = lines.select("id", "tag", "line", "node").join(rooted, "node").select("root", F.struct("id", "tag", "line").alias("place"))
    placed = written(placed, "line-places")
    firsts = placed.groupBy("root").agg(F.min("place").alias("first"))
    return placed.join(firsts, "root").where("place != first").select("place.*")


def deduplicated(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``documents`` with the lines that stay; ``n_chars``, if there is one, follows the text."""
    found = line_dedup(documents, similar)
    columns = {c: F.col("row")[c] for c in documents.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in columns:
        changed = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(documents.schema["n_chars"].dataType))
        columns["n_chars"] = F.coalesce(changed, F.col("row")["n_chars"])
    return found.select(*[columns[c].alias(c) for c in documents.columns])
