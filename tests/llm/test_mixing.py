from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerloom.llm import mixing


def filled(sizes, weights=(5, 2, 1), share=1.5, ceiling=2):
    """Targets by resharing the excess until none is above its ceiling."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    goal, target = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    while True:
        open_ = [s for s in sizes if target[s] < ceiling * sizes[s]]
        left = goal - sum(target[s] for s in sizes if s not in open_)
        if not open_:
            return target
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] >= ceiling * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: float(ceiling * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5000, "c": 30, None: 400, "": 7},
    {"a": 10, "b": 10, "c": 10},
    {"z": 0, "a": 0},
    {"one": 12345},
])
def test_targets_fill_up_to_the_ceiling(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(filled(sizes))


@pytest.mark.parametrize("seats", [0, 1, 2, 3, 7, 50, 997])
def test_seats_go_to_the_highest_quotients(spark, seats):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 1.0, "f": 24.0}
    frame = spark.createDataFrame([("g", n, w, seats) for n, w in weights.items()], "g string, n string, w double, seats long")
    got = {r["n"]: r["won"] for r in mixing.apportion(frame, ["g"], ["n"], "w", "seats").collect()}
    won = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max((w / (2 * won[n] + 1), -ord(n)) for n, w in weights.items() if w)
        won[chr(-best[1])] += 1
    assert got == won


def test_groups_are_apportioned_apart(spark):
    rows = [("x", "a", 1.0, 4), ("x", "b", 3.0, 4), ("y", "a", 1.0, 5)]
    frame = spark.createDataFrame(rows, "g string, n string, w double, seats long")
    won = {(r["g"], r["n"]): r["won"] for r in mixing.apportion(frame, ["g"], ["n"], "w", "seats").collect()}
    assert won == {("x", "a"): 1, ("x", "b"): 3, ("y", "a"): 5}


def test_messy_rows(messy, messy_rows):
    out = mixing.mix(messy()).collect()
    assert Counter(r["row"]["doc_id"] for r in out) == Counter(r[0] for r in messy_rows)
    sizes = defaultdict(int)
    for r in messy_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    target = filled(sizes)
    taken = defaultdict(int)
    for r in out:
        source = r["row"]["source"]
        assert r["size"] == len((r["row"]["text"] or "").encode().split())
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["source_size"], r["target"]) == (sizes[source], pytest.approx(target[source]))
        taken[source] += r["taken"]
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 3 * mixing.BLOCK
    again = mixing.mix(messy().repartition(5)).collect()
    pick = lambda rows: Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)
    assert pick(again) == pick(out)


def test_the_mix_holds_the_words_that_are_taken(spark, messy):
    docs = messy()
    plan = mixing.mix(docs).groupBy("source_size", "doc_id", "size").agg(F.sum("taken").alias("n")).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    whole = defaultdict(set)
    for r in docs.collect():
        whole[r["doc_id"]].add(" ".join((r["text"] or "").split()))
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].encode().split())
        assert any(" ".join(r["text"].split()) in t for t in whole[r["doc_id"]])
    expected = Counter()
    for r in plan:
        expected[r["doc_id"]] += r["n"]
    assert +words == +expected


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mixing.mix(docs).groupBy("row.source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r["n"] / r["t"] - 1) < 0.02 for r in out)


def test_empty_table(documents):
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mixed_documents(documents([])).collect() == []
