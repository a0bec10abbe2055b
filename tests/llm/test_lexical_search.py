import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest import SMALL
from ledgerloom.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    """Every document scored for every item, in plain integers."""
    listed = [(i, Counter(terms(t))) for i, t in docs]
    listed = [(i, c, sum(c.values())) for i, c in listed if c]
    n_docs, n_terms = len(listed), sum(n for *_, n in listed)
    df = Counter(t for _, c, _ in listed for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in listed:
            m = 75 + 25 * n * n_docs // n_terms
            s = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], start=1)]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.fixture
def items(spark):
    def build(pairs):
        return spark.createDataFrame([(i, t, "own") for i, t in pairs], "item_id long, text string, rank string")

    return build


def test_terms_of_odd_texts():
    texts = ["It's A-B_c 1.5 Ünïcode İX ΣA", None, "", "--- \x7f\x00", "日本 語x Y", "a" * 10_000 + "B"]
    flat, bounds = lexical_search.term_lists(pa.array(["skip me", *texts]).slice(1))
    assert [flat.to_pylist()[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [terms(t) for t in texts]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_messy_rows_on_both_sides(messy, messy_rows, items, k):
    docs = [(r[0], r[1]) for r in messy_rows]
    asked = [(1, "One two ONE alder1"), (2, None), (3, ""), (4, "??? --"), (4, messy_rows[0][1]), (4, messy_rows[0][1]), (None, "oak3 pine7 text"), (5, "nowhere-found")]
    got = found(lexical_search.ranked(messy().repartition(3), items(asked), k))
    assert got == brute(docs, asked, k) and got


def test_ties_go_to_smaller_ids_and_null_comes_last(documents, items):
    docs = [(i, "same words here") for i in (9, 4, 7, None, 2, 4)] + [(1, "other text")]
    got = lexical_search.ranked(documents(docs).repartition(4), items([(1, "same here")]), 6).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [2, 4, 4, 7, 9, None]
    few = lexical_search.ranked(documents(docs), items([(1, "same here")]), 2).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in few] == [(1, 2), (2, 4)]


def test_a_large_group_of_copies(documents, items):
    rng = random.Random(6)
    docs = [(i, "alder birch cedar " * 3) for i in range(400, 0, -1)]
    docs += [(1000 + i, " ".join(rng.choice("alder birch cedar elm fir oak".split()) for _ in range(9))) for i in range(300)]
    asked = [(1, "birch cedar cedar"), (2, "elm fir"), (3, "alder")]
    assert found(lexical_search.ranked(documents(docs).repartition(7), items(asked), 20)) == brute(docs, asked)


def test_random_tables_in_small_buckets_and_blocks(documents, items, monkeypatch):
    monkeypatch.setattr(lexical_search, "BUCKET", 8)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(lexical_search, "FOCUS", 2)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]

    def text(most):
        return " ".join(vocabulary[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randrange(most)))

    docs = [(i, text(60)) for i in range(250)]
    asked = [(i, text(12)) for i in range(8)]
    assert found(lexical_search.ranked(documents(docs).repartition(3), items(asked), 5)) == brute(docs, asked, 5)


def test_bounds_leave_most_documents_unscored(spark):
    """The buckets' and coordinates' bounds do their work: most pairs are never scored."""
    rng = np.random.default_rng(8)
    n_terms, n = 300, 4000
    items = lexical_search.Items([1, 2], [" ".join(f"t{i}" for i in range(150)), " ".join(f"t{i}" for i in range(150, 300))])
    place = {t: i for i, t in enumerate(items.terms.to_pylist())}
    items.weigh(np.full(n_terms, 3000))
    best = lexical_search.Best(items, np.ones(2, np.int64), 5)
    scale = np.sort(rng.exponential(1, n))[::-1]
    for first in range(0, n, 500):
        sizes = np.full(500, 10)
        terms = np.concatenate([rng.choice(n_terms, 10, replace=False) for _ in range(500)])
        impacts = (np.repeat(scale[first : first + 500], 10) * 100_000).astype(np.int64)
        squares = np.bincount(np.repeat(np.arange(500), 10), (impacts * items.root[terms]) ** 2)
        order = np.argsort(-squares, kind="stable")
        assert (order == np.arange(500)).all() or np.allclose(squares[order], squares)
        best.visit(lexical_search.Bucket(np.zeros(500, bool), np.arange(first, first + 500), squares, sizes, terms, impacts, items.root))
    assert 0 < best.scored < n and len(place) == n_terms


def test_empty_tables(documents, items):
    some = documents([(1, "one two")])
    assert found(lexical_search.ranked(documents([]), items([(1, "one")]))) == []
    assert found(lexical_search.ranked(documents([(1, None), (2, " - ")]), items([(1, "one")]))) == []
    assert found(lexical_search.ranked(some, items([]))) == []
    assert found(lexical_search.ranked(some, items([(1, "three")]))) == []


def test_whole_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    asked = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = lexical_search.ranked(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert found(got) == brute(docs, asked)
