"""Document fingerprints: weighted term hashes vote on signed bits, all in DataFrame functions.

A term is a word with the word after it (the last word stands alone), its weight grows
with its length, so that short everyday words count little. Votes are summed two bits
to a number: each of the 32 sums of a hash holds bit i in its low and bit i + 32 in its
high half, which leaves room for 2**32 of total weight per document.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import written
from ledgerloom.llm.text import words

HASHES = 2
BITS = 64 * HASHES
# Most that one term can weigh.
HEAVIEST = 15
# Rows of an order bucket, about, and cells that quantiles cut the ids into.
BUCKET_ROWS, CELLS = 1024, 512

LANES = (1 << 32) | 1


def _terms(text: Column) -> Column:
    listed = words(text)
    after = F.slice(listed, F.lit(2), F.greatest(F.size(listed), F.lit(1)))
    return F.arrays_zip(listed.alias("a"), after.alias("b"))


def fingerprint_of(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``fp``, an array of ``HASHES`` numbers: one row per distinct ``keys``.

    A bit is set if the terms with it outweigh those without; no words give all zeros.
    """
    terms = rows.select(*keys, F.inline_outer(_terms(F.col(text))).alias("a", "b"))
    weight = F.least(F.lit(HEAVIEST), F.octet_length("a") + F.coalesce(F.octet_length("b"), F.lit(0)))
    hashed = terms.select(
        *keys,
        F.when(F.col("a").isNull(), 0).otherwise(weight).cast("long").alias("w"),
        *[F.xxhash64("a", "b", F.lit(i)).alias(f"h{i}") for i in range(HASHES)],
    )
    votes = [
        F.sum(F.shiftrightunsigned(f"h{i}", j).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{i}_{j}")
        for i in range(HASHES)
        for j in range(32)
    ]
    summed = hashed.groupBy(*keys).agg(F.sum("w").alias("w"), *votes)

    def number(i: int) -> Column:
        bits = []
        for j in range(32):
            both = F.col(f"v{i}_{j}")
            low, high = both.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(both, 32)
            bits.append(F.when(low * 2 > F.col("w"), F.lit(_bit(j))).otherwise(F.lit(0).cast("long")))
            bits.append(F.when(high * 2 > F.col("w"), F.lit(_bit(j + 32))).otherwise(F.lit(0).cast("long")))
        return reduce(Column.bitwiseOR, bits)

    return summed.select(*keys, F.array(*[number(i) for i in range(HASHES)]).alias("fp"))


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    apart = [F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))) for i in range(HASHES)]
    return 1 - reduce(Column.__add__, apart) / F.lit(float(BITS))


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits per number of a fingerprint."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.element_at(fp, i + 1)), 16, "0")) for i in range(HASHES)])


def in_buckets(rows: DataFrame, key: str) -> DataFrame:
    """Add ``bucket``, which never falls as ``key`` rises and holds about ``BUCKET_ROWS`` rows; -1 for null.

    Quantiles cut the keys into at most ``CELLS`` cells, equal steps cut each cell further.
    The plan holds two numbers per cell, whatever the number of rows.
    """
    facts = rows.agg(
        F.count(key).alias("n"),
        F.max(key).alias("high"),
        F.percentile_approx(key, [i / CELLS for i in range(CELLS)], CELLS * 20).alias("cuts"),
    ).first()
    cuts = sorted(set(facts["cuts"] or [0]))
    steps = max(1, round(facts["n"] / BUCKET_ROWS / len(cuts)))
    if facts["n"] <= BUCKET_ROWS * len(cuts):  # few rows: as many cells as buckets
        keep = max(1, -(-facts["n"] // BUCKET_ROWS))
        cuts = cuts[:: max(1, len(cuts) // keep)]
    ends = [*cuts[1:], (facts["high"] or 0) + 1]
    at = F.col(key)
    cell = F.greatest(F.lit(1), F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at)))
    low, high = F.element_at(F.array(*map(F.lit, cuts)), F.col("cell")), F.element_at(F.array(*map(F.lit, ends)), F.col("cell"))
    step = F.floor((at - low).cast("double") / (high - low) * steps)
    celled = rows.withColumn("cell", F.when(at.isNotNull(), cell))
    inner = F.greatest(F.lit(0), F.least(F.lit(steps - 1), step))
    return celled.withColumn("bucket", F.coalesce(F.col("cell") * F.lit(steps).cast("long") + inner, F.lit(-1))).drop("cell")


def with_next(rows: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the row that follows in descending buckets and ``order`` within
    a bucket; the first row of all follows the last one.

    A bucket's last row looks at the first of the next bucket that has rows; only those
    first rows are joined.
    """
    inner = Window.partitionBy("bucket").orderBy(*order)
    firsts = rows.select("bucket", value, F.row_number().over(inner).alias("n")).where("n = 1").select(F.col("bucket").alias("head"), F.col(value).alias("head_value"))
    # One short row per bucket.
    filled = rows.groupBy("bucket").agg(F.count("*").alias("rows"))
    falling = Window.orderBy(F.col("bucket").desc())
    following = filled.select(
        F.col("bucket").alias("before"),
        F.coalesce(F.lead("bucket").over(falling), F.first("bucket").over(falling)).alias("head"),
    )
    heads = following.join(firsts, "head").select("before", "head_value")
    led = rows.withColumn("led", F.lead(F.struct(value)).over(inner))
    joined = led.join(heads, F.col("bucket") == F.col("before"), "left")
    chosen = F.when(F.col("led").isNull(), F.col("head_value")).otherwise(F.col(f"led.{value}"))
    return joined.select(*rows.columns, chosen.alias(out))


def document_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited form, with how alike they are.

    ``doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next`` per input
    row. In the edited text the last half of the characters gives way to as many first
    ones of the next document in descending ``doc_id``; the first document follows the
    last, null ids come last, rows with one id follow each other in text order. Null
    texts are empty; an empty text has fingerprint zero. Repeated rows give repeated
    rows, other columns are ignored, an empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    bucketed = in_buckets(rows, "doc_id")
    placed = with_next(bucketed, order, "text", "next_text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    both = placed.select("bucket", turn.alias("turn"), "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    versions = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")),
    )
    digest = F.unhex(F.sha2("edited", 256)).alias("digest")
    listed = both.select("bucket", "turn", "doc_id", "n_chars", digest, F.inline(versions))
    keys = ["bucket", "turn", "doc_id", "n_chars", "digest"]
    voted = fingerprint_of(listed, [*keys, "version"], "body")
    paired = voted.groupBy(*keys).agg(
        F.max(F.when(F.col("version") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("version") == 1, F.col("fp"))).alias("edited_fp"),
    )
    nexts = with_next(written(paired, "document-fingerprints"), [F.col("turn")], "fp", "next_fp")
    return nexts.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("digest")).alias("edited_sha256"),
        "fp",
        "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def block_tables(radius: int, agreeing: int = 2) -> list[list[int]]:
    """For every choice of blocks that fingerprints within ``radius`` share: a mask per number."""
    n = radius + agreeing
    edges = [BITS * i // n for i in range(n + 1)]
    out = []
    for chosen in combinations(range(n), agreeing):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        parts = [mask >> (64 * i) & ((1 << 64) - 1) for i in range(HASHES)]
        out.append([p - (1 << 64) if p >> 63 else p for p in parts])
    return out


def within(queries: DataFrame, fingerprinted: DataFrame, radius: int = 6) -> DataFrame:
    """``query_fp, fp, apart``: all distinct fingerprints of ``fingerprinted`` (column ``fp``) within
    ``radius`` bits of each distinct one of ``queries``, itself included if it is there.

    One table per choice of blocks, in which the chosen blocks come first as the key; a pair
    is taken from the first table that brings it together. Null fingerprints are left out.
    """
    masks = block_tables(radius)

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        distinct = rows.where("fp is not null").select(F.col("fp").alias(name)).distinct()
        tables = [
            F.struct(F.lit(t).alias("t"), *[F.element_at(F.col(name), i + 1).bitwiseAND(F.lit(m[i])).alias(f"k{i}") for i in range(HASHES)])
            for t, m in enumerate(masks)
        ]
        return distinct.select(name, F.inline(F.array(*tables)))

    key = ["t", *[f"k{i}" for i in range(HASHES)]]
    met = keyed(queries, "query_fp").join(keyed(fingerprinted, "fp"), key)
    apart = ((1 - likeness(F.col("query_fp"), F.col("fp"))) * BITS).cast("int")
    return met.withColumn("apart", apart).where(F.col("apart") <= radius).select("query_fp", "fp", "apart").distinct()
