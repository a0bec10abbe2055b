import random
from collections import Counter

import pytest
import xxhash

from conftest import SMALL
from ledgerloom.llm import simhash_blocks as S


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {v: find(v) for v in listed}


def by_hand(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = groups(fps, 2)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    return Counter((i, f"{f:016x}", least.get(group[f])) for (i, _), f in zip(rows, fps, strict=True))


def found(df):
    return Counter(tuple(r) for r in S.near_duplicates(df).select("doc_id", S.hex_digits(), "component_id").collect())


def test_messy_rows(messy, messy_rows):
    assert found(messy()) == by_hand([r[:2] for r in messy_rows])


def test_whole_table_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(docs) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize(("radius", "crowd"), [(2, 1000), (2, 4), (1, 4), (3, 4), (4, 3)])
def test_links_connect_what_hamming_distance_connects(spark, radius, crowd):
    """Near copies of a few centres, with crowded keys and without."""
    rng = random.Random(radius * 10 + crowd)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.links(frame, radius, crowd).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in edges)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[find(a)] = find(b)
    expected = groups(values, radius)
    assert len({(find(v), expected[v]) for v in values}) == len({find(v) for v in values}) == len(set(expected.values()))


def test_one_of_each_group_stays(messy, messy_rows):
    kept = S.keep_one(messy())
    assert kept.columns == messy().columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    expected = {c for _, _, c in by_hand([r[:2] for r in messy_rows]) if c is not None}
    assert {i for i in ids if i is not None} == expected
    assert all(n == 1 for i, n in ids.items() if i not in (None, 11)) and ids[None] == 2


def test_empty_table(documents):
    assert S.near_duplicates(documents([])).collect() == []
    assert S.keep_one(documents([])).collect() == []
