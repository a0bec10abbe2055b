"""Sketches against the sets themselves, and tables that scratch removes."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.sketch import MAPS, may_be_similar, sketches
from ledgerloom.llm.store import scratch, written


def _columns(sets, repeats=1):
    hashes = [h for s in sets for h in list(s) * repeats]
    return sketches(np.array(hashes, np.uint64), np.array([len(s) * repeats for s in sets], np.int64))


def test_size_and_parity_are_those_of_the_set_whatever_repeats():
    rng = random.Random(1)
    sets = [{rng.getrandbits(64) for _ in range(n)} for n in (1, 7, 90, 2000)]
    once, twice = _columns(sets), _columns(sets, 2)
    assert once[0].to_pylist() == [len(s) for s in sets]
    assert [c.to_pylist() for c in once] == [c.to_pylist() for c in twice]
    assert [len(c) for c in _columns([])] == [0] * (1 + len(MAPS))


def test_no_similar_pair_is_ruled_out_and_most_others_are(spark):
    rng = random.Random(2)
    sets, pairs = [], []
    for _ in range(400):
        size, changed = rng.randrange(2, 300), rng.random() ** 2
        a = {rng.getrandbits(64) for _ in range(size)}
        kept = set(rng.sample(sorted(a), round(size * (1 - changed))))
        b = kept | {rng.getrandbits(64) for _ in range(rng.randrange(1 + size - len(kept)))}
        sets += [a, b or a]
    columns = [c.to_pylist() for c in _columns(sets)]
    rows = list(zip(*columns, strict=True))
    for i in range(0, len(sets), 2):
        a, b = sets[i], sets[i + 1]
        pairs.append((len(a & b) / len(a | b), *rows[i], *rows[i + 1]))
    names = ["similarity", "size", *MAPS, "other_size", *[f"other_{m}" for m in MAPS]]
    for similar in (0.5, 0.8, 1.0):
        judged = spark.createDataFrame(pairs, names).withColumn("may", may_be_similar(similar)).select("similarity", "may").collect()
        assert all(r.may for r in judged if r.similarity >= similar)
        assert sum(r.may for r in judged if r.similarity < similar - 0.3) <= 0.2 * len(judged)


def test_long_sets_that_are_not_similar_are_ruled_out(spark):
    rng = random.Random(3)
    pairs = []
    for share in [0.6] * 50 + [0.82] * 50:
        common = [rng.getrandbits(64) for _ in range(round(600 * share))]
        a, b = ([*common, *[rng.getrandbits(64) for _ in range(300 - len(common) // 2)]] for _ in range(2))
        first, second = zip(*[c.to_pylist() for c in _columns([a, b])], strict=True)
        pairs.append((share, *first, *second))
    names = ["similarity", "size", *MAPS, "other_size", *[f"other_{m}" for m in MAPS]]
    judged = spark.createDataFrame(pairs, names).select("similarity", may_be_similar(0.8).alias("may")).collect()
    assert all(r.may == (r.similarity > 0.8) for r in judged)


def test_scratch_removes_what_does_not_outlive_it(spark):
    def path(df):
        return Path(df.inputFiles()[0].removeprefix("file://"))

    one = spark.range(5)
    with scratch(spark):
        with scratch(spark):
            gone, outer = written(one, "t"), written(one, "t", outlives=True)
            gone_at, outer_at = path(gone), path(outer)
        assert not gone_at.exists() and outer_at.exists()
        kept = written(outer.select((F.col("id") * 2).alias("id")), "t", outlives=True)
    assert not outer_at.exists()
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4, 6, 8]
