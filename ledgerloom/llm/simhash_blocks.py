"""SimHash near-dedup: word-shingle fingerprints joined on shared blocks of bits.

A 64-bit fingerprint falls into ``radius + 2`` blocks. Two fingerprints that
differ in at most ``radius`` bits agree on two blocks at least, so each pair of
blocks is a join key and the full Hamming distance is verified after the join.

A key that many distinct fingerprints share is not joined pairwise. There, for
radius 2, each fingerprint is listed under itself and its 64 one-bit variants:
two fingerprints have a variant in common exactly when they differ in two bits
at most, so linking each variant's fingerprints to their smallest one is exact
and makes rows in proportion to the fingerprints. Other radii split a crowded
key by a third block first and then compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.store import written
from ledgerloom.llm.text import slices, texts_of

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
# Distinct fingerprints under one key that are still compared pairwise.
CROWD = 48


def fingerprint(text: str | bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text: bit i is set if it is set in over half of the shingle hashes."""
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    if len(words) <= shingle:
        spans = [(0, len(line))]
    else:
        starts = np.concatenate(([0], ends[:-shingle]))
        spans = zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16), None].view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    on = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(on.view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values = np.array([fingerprint(t, shingle) for t in texts_of(part)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` per row; the fingerprint is a signed 64-bit number, 0 without words."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(radius: int, agreeing: int) -> list[int]:
    """Bit masks of every choice of blocks of which close fingerprints share one."""
    n = radius + agreeing
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(blocks, agreeing)]


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint once under each block key: ``fp, choice, key``."""
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return fps.select("fp", F.inline(keys))


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that connect exactly the
    pairs within ``radius`` bits: crowded keys give stars, the others the pairs themselves."""
    agreeing = 2
    keyed = _keyed(fps, _masks(radius, agreeing))
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(shared, ["choice", "key"]), "block-members")
    few = members.where(F.col("n") <= crowd)
    edges = _pairs(few, ["choice", "key"], radius)
    crowded = members.where(F.col("n") > crowd).select("fp").distinct()
    if radius == 2:
        return edges.union(_variant_stars(crowded)).distinct()
    finer = _keyed(crowded, _masks(radius, agreeing + 2))
    return edges.union(_pairs(finer, ["choice", "key"], radius)).distinct()


def _pairs(members: DataFrame, key: list[str], radius: int) -> DataFrame:
    left = members.select(*key, F.col("fp").alias("a"))
    right = members.select(*key, F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return left.join(right, key).where((F.col("a") < F.col("b")) & near).select("a", "b")


def _variant_stars(fps: DataFrame) -> DataFrame:
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    listed = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    least = listed.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    return listed.join(least, "variant").where("fp > a").select("a", F.col("fp").alias("b"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``.

    Documents link when their fingerprints differ in at most ``radius`` bits, and a
    component is what links reach; ``component_id`` is its smallest ``doc_id``. Texts
    are lower-cased (A-Z) and cut into word shingles; a text of fewer words is one
    shingle. Null, empty and blank texts have fingerprint 0 and link like any other.
    Equal texts always share a component. A row with a null ``doc_id`` joins its
    component but cannot name it (null if no row of it has an id). Repeated rows give
    repeated rows; further columns are ignored; an empty table gives no rows.
    """
    rows = written(fingerprints(documents, shingle), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    group = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(group, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """16 lower-case hexadecimal digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``documents`` with one row of each component: the one with the smallest ``doc_id``.

    Of repeated rows with that id one stays, also if their texts differ; rows without an
    id all stay. The pipeline takes ``near_texts.one_of_similar``, which has the same
    links and further ones, and tells rows apart by their texts.
    """
    found = near_duplicates(documents, radius, shingle)
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies"))
    # The name cannot clash with a column of the input.
    copies = "copies_" + "_".join(documents.columns).replace(".", "_")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    kept = documents.join(keep.withColumnRenamed("copies", copies), "doc_id")
    once = kept.where(F.col(f"`{copies}`") == 1).select(columns)
    twice = kept.where(F.col(f"`{copies}`") > 1).select(columns).dropDuplicates(["doc_id"])
    nameless = documents.where("doc_id is null")
    return once.union(twice).union(nameless)
