from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerloom.llm import boosted, quality_trees
from ledgerloom.llm.queries import op8_quality_classifier


def walk(forest, x):
    """Row by row and node by node."""
    out = []
    for row in x:
        raw = forest.start
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            raw += leaf[node - len(f)]
        out.append(1 / (1 + np.exp(-raw)))
    return out


def test_arrays_are_walked_like_trees():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=800), rng.integers(0, 3, 800), np.zeros(800)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] == 1)).astype(float)
    forest = boosted.grow(x, y, trees=30, depth=3)
    assert np.allclose(forest.score(x), walk(forest, x))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_first_split_has_the_largest_gain():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (300, 2)).astype(float)
    y = (x[:, 1] > 7).astype(float)
    forest = boosted.grow(x, y, trees=1, depth=1)
    gains = {}
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    for f in range(2):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= 20:
                gains[f, cut] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == max(gains, key=gains.get) == (1, 7)


def test_one_class_or_no_rows_give_a_constant():
    x = np.zeros((0, 4))
    assert boosted.grow(x, np.zeros(0)).score(np.ones((3, 4))).tolist() == [0.5] * 3
    assert (boosted.grow(np.ones((50, 2)), np.ones(50)).score(np.zeros((2, 2))) > 0.9).all()


def test_statistics_are_defined_for_any_text():
    x = quality_trees.table(["", " ", "a", "\n\n", "Ü" * 10, "A!! B!! " * 5000, "|", "0x1f\x00"])
    assert x.shape == (8, len(quality_trees.STATISTICS)) and np.isfinite(x).all()


def test_held_out_rows_of_the_given_table(spark):
    sf = SMALL.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op8_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    ones, zeros = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    wins = np.mean([(np.array(zeros) < s).mean() for s in ones])
    assert wins > 0.97 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_messy_rows_and_labels(spark, messy, messy_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, None), (None, 1), (99, 0), (9, 0)], "doc_id long, label int")
    forest = quality_trees.train(messy(), labels)
    rows = quality_trees.quality(messy(), forest).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in messy_rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    seen = []
    original = quality_trees.grow
    try:
        quality_trees.grow = lambda x, y: seen.append(len(y)) or original(x, y, trees=1)
        quality_trees.train(docs, labels, most=200)
    finally:
        quality_trees.grow = original
    assert 120 < seen[0] < 280


def test_empty_table(documents, spark):
    forest = quality_trees.train(documents([]), spark.createDataFrame([], "doc_id long, label int"))
    assert quality_trees.quality(documents([]), forest).collect() == []
