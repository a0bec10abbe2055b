"""Copies of a row, one id for many texts, and column names with a dot."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import lines, mixing, near_texts, quality_trees, spans
from tests.llm.conftest import SCHEMA


def _row(i, text, lang="en"):
    return (i, text, lang, "a", len(text or ""))


def test_windows_grow_in_proportion_to_copies(spark, monkeypatch):
    """Each further copy of the first holder adds the same number; the other document has some of its own."""
    rng = np.random.default_rng(3)
    seen = []
    kept = spans.written

    def counted(df, name):
        table = kept(df, name)
        if name == "windows":
            seen.append(table.count())
        return table

    monkeypatch.setattr(spans, "written", counted)
    one = " ".join(f"w{x}" for x in rng.integers(0, 1000, 300))
    other = " ".join(one.split()[:170] + [f"v{x}" for x in range(130)])
    for copies in (4, 8, 12):
        rows = [_row(1, one)] * copies + [_row(2, other)]
        found = spans.substring_dedup(spark.createDataFrame(rows, SCHEMA)).groupBy("doc_id").agg(F.max("n_removed").alias("n")).collect()
        assert {r["doc_id"]: r["n"] for r in found} == {1: 0, 2: 170}
    assert 0 < seen[1] - seen[0] == seen[2] - seen[1] < seen[0]


def test_an_id_of_many_texts_counts_once_in_the_sample(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality_trees, "grow", lambda x, y: fitted.append((x, y)))
    rows = [_row(1, f"text number {i} of one id") for i in range(50)] + [_row(2, "other text"), _row(3, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, label int")
    quality_trees.train(spark.createDataFrame(rows, SCHEMA), labels, 10_000)
    x, y = fitted[0]
    assert len(x) == len(y) == 3 and sorted(y.tolist()) == [0, 1, 1]


def test_columns_with_a_dot_are_carried(spark):
    rows = [_row(i, f"some words of document {i} and more words") for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("a.b", F.lit("x"))
    for out in (mixing.mixed_documents(docs), near_texts.one_of_similar(docs), lines.deduplicated(docs)):
        assert set(docs.columns) <= set(out.columns)
        assert {r["a.b"] for r in out.collect()} == {"x"}
