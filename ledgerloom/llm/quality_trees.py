"""Quality scores of documents: boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.boosted import Forest, grow
from ledgerloom.llm.text import slices, texts_of

# Labelled documents that the trees are fitted on, about.
SAMPLE_LABELS = 12_000
CUTOFF = 0.3
# Marks whose share of the text is a statistic of its own.
MARKS = b".,;:!?|#*$&%-_=<>/\\()[]{}\"'@+~^`"

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "spread_word", "longest_word", "short_words", "distinct_words",
    "top_word", "top_ten_words", "words_with_mark", "words_without_letter", "words_all_capitals",
    "words_with_digit", "lines", "mean_line", "distinct_lines", "repeated_line_bytes", "distinct_pairs",
    "letters", "capitals", "digits", "spaces", "beyond_ascii", "byte_entropy", "word_entropy", "sentence_words",
) + tuple(f"mark_{m:02x}" for m in MARKS)

_MARK = np.frombuffer(MARKS, np.uint8)
_EDGE = MARKS


def statistics(text: str) -> list[float]:
    """The statistics of one text in the order of ``STATISTICS``; all defined for an empty text."""
    raw = text.encode()
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.array([len(w) for w in words] or [0])
    seen = Counter(words)
    top = [c for _, c in seen.most_common(10)] or [0]
    share = np.fromiter(seen.values(), np.float64, len(seen)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_seen = Counter(lines)
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = int(byte[65:91].sum() + byte[97:123].sum())
    there = byte[byte > 0] / size
    distinct = list(seen.items())
    marked = sum(c for w, c in distinct if w[-1] in _EDGE or w[0] in _EDGE)
    bare = sum(c for w, c in distinct if not w.upper() != w.lower())
    shouted = sum(c for w, c in distinct if len(w) > 1 and w.isupper())
    numbered = sum(c for w, c in distinct if any(48 <= x <= 57 for x in w))
    ends = int(byte[46] + byte[33] + byte[63])
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max(),
        (lengths <= 3).sum() / n, len(seen) / n, top[0] / n, sum(top) / n, marked / n, bare / n, shouted / n, numbered / n,
        np.log1p(len(lines)), np.log1p(size / max(len(lines), 1)), len(line_seen) / max(len(lines), 1),
        sum((c - 1) * len(x) for x, c in line_seen.items()) / size, pairs / max(len(words) - 1, 1),
        letters / size, byte[65:91].sum() / max(letters, 1), byte[48:58].sum() / size, (byte[32] + byte[9:14].sum()) / size,
        byte[128:].sum() / size, -(there * np.log(there)).sum(), -(share * np.log(share)).sum(), np.log1p(n / max(ends, 1)),
        *(byte[_MARK] / size),
    ]


def table(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = table(texts_of(part))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_LABELS) -> Forest:
    """Fit on ``labels`` (``doc_id, label``), about ``most`` of them chosen by a hash of the id.

    A document labelled more than once counts as 1 if at least half its labels are 1; null
    ids and labels are left out. An id that several rows share counts once, with the
    smallest of its texts. Only the sample's statistics come to the driver.
    """
    known = labels.where("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    count = known.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_003)) / 1_000_003
    chosen = known.where(drawn < most / max(count, 1))
    # About `most` rows of two small numbers, whatever the size of the tables.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    found: pd.DataFrame = rows.mapInArrow(_described, "label int, x array<double>").toPandas()
    x = np.array(found.x.tolist()).reshape(len(found), len(STATISTICS))
    order = np.lexsort(x.T)  # the fit does not depend on the order of arrival
    return grow(x[order], found.label.to_numpy(np.float64)[order])


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            score = shared.value.score(table(texts_of(part)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def quality(documents: DataFrame, forest: Forest, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id, score, predicted`` per input row: probability that its label is 1, and whether
    it reaches ``cutoff``.

    Only the text counts. Null and empty texts have defined statistics and are scored like
    others; repeated rows give repeated rows, other columns are ignored, no rows give none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(forest)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(lambda it: _scored(it, shared), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
