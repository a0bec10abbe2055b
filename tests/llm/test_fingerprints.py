import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerloom.llm import fingerprints as P


def term_hashes(spark, texts):
    """Hash numbers of every term of the texts, by a plain projection."""
    terms = {(a, b) for t in texts for a, b in pairs(t)}
    rows = spark.createDataFrame(list(terms) or [("", "")], "a string, b string")
    hashed = rows.select("a", "b", *[F.xxhash64("a", "b", F.lit(i)).alias(f"h{i}") for i in range(P.HASHES)]).collect()
    return {(r["a"], r["b"]): [r[f"h{i}"] % (1 << 64) for i in range(P.HASHES)] for r in hashed}


def pairs(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return list(zip(words, [*words[1:], None][: len(words)], strict=True))


def plain_fingerprint(text, hashes):
    votes, total = [0] * P.BITS, 0
    for a, b in pairs(text):
        w = min(P.HEAVIEST, len(a.encode()) + len((b or "").encode()))
        total += w
        for i, h in enumerate(hashes[a, b]):
            for j in range(64):
                votes[64 * i + j] += w * (h >> j & 1)
    numbers = [sum(1 << j for j in range(64) if 2 * votes[64 * i + j] > total) for i in range(P.HASHES)]
    return "".join(f"{n:016x}" for n in numbers)


def by_hand(spark, rows):
    """Rows in descending id, null last, then by text; each with its follower."""
    listed = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out, edits = [], []
    for (i, t), (_, after) in zip(listed, listed[1:] + listed[:1], strict=True):
        half = len(t) // 2
        edits.append(t[: len(t) - half] + after[:half])
    hashes = term_hashes(spark, [t for _, t in listed] + edits)
    own = [plain_fingerprint(t, hashes) for _, t in listed]
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / P.BITS
    for k, ((i, t), e) in enumerate(zip(listed, edits, strict=True)):
        f, after = plain_fingerprint(e, hashes), own[(k + 1) % len(own)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), own[k], f, like(own[k], f), like(own[k], after)))
    return Counter(out)


def found(df):
    out = P.document_fingerprints(df)
    rows = out.select("doc_id", "n_chars", "edited_sha256", P.hex_digits(F.col("fp")), P.hex_digits(F.col("edited_fp")), "near_edited", "near_next")
    return Counter(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("bucket", [8192, 3])
def test_messy_rows(spark, messy, messy_rows, monkeypatch, bucket):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket)
    assert found(messy()) == by_hand(spark, [r[:2] for r in messy_rows])


@pytest.mark.parametrize(("bucket", "cells"), [(8192, 512), (7, 4)])
def test_whole_table_by_hand(spark, monkeypatch, bucket, cells):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(P, "CELLS", cells)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = found(docs)
    assert got == by_hand(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])
    near = [(r[5], r[6]) for r in got]
    assert sum(a > b for a, b in near) > 0.95 * len(near)


@pytest.mark.parametrize("ids", [[5], [7, 7, 7, 7], [None, None], [-(1 << 62), 0, 1 << 62, (1 << 62) + 1], list(range(0, 3000, 100)) + [10**15]])
def test_order_of_any_ids(spark, documents, monkeypatch, ids):
    monkeypatch.setattr(P, "BUCKET_ROWS", 2)
    rows = [(i, f"text {k} of {i}") for k, i in enumerate(ids)]
    assert found(documents(rows)) == by_hand(spark, rows)


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_tables_find_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    values = {0, (1 << P.BITS) - 1}
    for _ in range(4):
        centre = rng.getrandbits(P.BITS)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(P.BITS), rng.randrange(10))) for _ in range(40)}
    signed = lambda v: [(v >> 64 * i) % (1 << 64) - (1 << 64 if v >> 64 * i >> 63 & 1 else 0) for i in range(P.HASHES)]
    frame = spark.createDataFrame([(signed(v),) for v in values] + [(None,)], "fp array<long>")
    number = lambda a: sum(x % (1 << 64) << 64 * i for i, x in enumerate(a))
    asked = sorted(values)[::5]
    queries = spark.createDataFrame([(signed(v),) for v in asked], "fp array<long>")
    got = {(number(r["query_fp"]), number(r["fp"]), r["apart"]) for r in P.within(queries, frame, radius).collect()}
    assert got == {(a, b, (a ^ b).bit_count()) for a in asked for b in values if (a ^ b).bit_count() <= radius}


def test_empty_table(documents):
    assert P.document_fingerprints(documents([])).collect() == []
