"""Language identification by character models, one per language of the training rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.kneser_ney import ORDER, Model, fit, symbols
from ledgerloom.llm.text import slices, texts_of

UNKNOWN = "und"
# Documents per language that the models are fitted on, about; a tenth of them calibrates.
SAMPLE_DOCS = 1500
# Text handled at once; small, as 100 to 300 bytes of arrays go with each character.
SLICE = 1 << 18
# Share of a language's calibration texts whose excess bounds what is accepted.
USUAL_SHARE = 0.9
# Letters at which the spread of a text's cross-entropy has halved towards that of long texts.
SHORT = 30.0


@dataclass
class LanguageId:
    """Fitted models with their calibration."""

    model: Model
    #: Weight of a text's log-likelihood differences in its score.
    sharpness: float
    #: Per language: usual cross-entropy and how far above it a text is still accepted.
    usual: np.ndarray
    slack: np.ndarray

    def decide(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and whether it is rejected, from cross-entropies per text."""
        best = entropy.argmin(axis=1)
        score = confidence(entropy, n, self.sharpness)
        excess = (entropy.min(axis=1) - self.usual[best]) / spread(n)
        return best, score, excess > self.slack[best]


def spread(n: np.ndarray) -> np.ndarray:
    return np.sqrt(1 + SHORT / np.maximum(n, 1))


def confidence(entropy: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    ahead = entropy - entropy.min(axis=1, keepdims=True)
    return 1 / np.exp(-sharpness * n[:, None] * ahead).sum(axis=1)


def cross_entropy(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: nats per symbol under each language, number of symbols, number of letters."""
    s = symbols(texts)
    n = np.diff(s.bounds)
    sums = np.zeros((len(texts), len(model.languages)))
    some = np.flatnonzero(n)
    if len(some):
        logp = model.log_probabilities(s.codes, s.at)
        sums[some] = np.add.reduceat(logp, s.bounds[:-1][some], axis=0, dtype=np.float64)
    return -sums / np.maximum(n, 1)[:, None], n, s.letters


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SLICE):
            frame = part.to_pandas()
            for lang, own in frame.groupby("lang"):
                s = symbols(own.text.tolist())
                runs = np.stack([s.codes[s.at - j] for j in range(ORDER - 1, -1, -1)], axis=1).astype(np.int32)
                table = pd.DataFrame(runs, columns=[f"c{j}" for j in range(ORDER)])
                found = table.value_counts().rename("n").reset_index()
                found.insert(0, "lang", lang)
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)


def _calibration_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SLICE):
            entropy, n, _ = cross_entropy(shared.value, texts_of(part))
            lists = pa.array(entropy.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("lang"), lists, pa.array(n)], names=["lang", "entropy", "n"])


def sample(training: DataFrame, docs: int) -> DataFrame:
    """About ``docs`` distinct texts of each language, chosen by a hash of the text; ``fold`` from 0 to 9."""
    # A row per language. Copies of a text count once: all of them are drawn or none.
    counts = training.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("count")).collect()
    if not counts:
        return training.select("lang", "text", F.lit(0).alias("fold")).limit(0)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(docs / r["count"]))])
    drawn = F.pmod(F.xxhash64("text", F.lit("language sample")), F.lit(1_000_003)) / 1_000_003
    fold = F.pmod(F.xxhash64("text", F.lit("language fold")), F.lit(10)).alias("fold")
    return training.where(drawn < share[F.col("lang")]).select("lang", "text", fold).dropDuplicates(["lang", "text"])


def train(training: DataFrame, docs: int = SAMPLE_DOCS) -> LanguageId | None:
    """Fit on ``lang, text`` rows; None when no row has both.

    The counts of distinct character runs come to the driver: at most the runs of
    ``docs`` documents per language, however large the table is.
    """
    chosen = sample(training.where("lang is not null and text is not null").select("lang", "text"), docs)
    runs = [f"c{j}" for j in range(ORDER)]
    schema = "lang string, " + ", ".join(f"{c} int" for c in runs) + ", n long"
    counted = chosen.where("fold > 0").mapInArrow(_count, schema).groupBy("lang", *runs).agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    if table.empty:  # too few texts to set some aside
        table = chosen.mapInArrow(_count, schema).groupBy("lang", *runs).agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return None
    languages = sorted(table.lang.unique())
    wide = table.pivot_table(index=runs, columns="lang", values="n", fill_value=0)[languages]
    model = fit(languages, wide.index.to_frame().to_numpy(), wide.to_numpy())
    shared = training.sparkSession.sparkContext.broadcast(model)
    rows = chosen.where("fold = 0").mapInArrow(lambda it: _calibration_rows(it, shared), "lang string, entropy array<double>, n long")
    return calibrate(model, rows.toPandas())


def calibrate(model: Model, rows: pd.DataFrame) -> LanguageId:
    """Sharpness with the least log-loss, and the largest excess that accepted texts may have.

    A text is rejected if its best language explains it worse, by twice as much, than
    that language explains nine tenths of its own calibration texts (and by two nats a
    symbol at least, so that odd but genuine texts stay). A few mislabelled texts do not
    move that bound.
    """
    rows = rows[(rows.n > 0) & rows.lang.isin(model.languages)]
    count = len(model.languages)
    usual, slack = np.full(count, np.log(1 << 20)), np.zeros(count)
    if rows.empty:
        return LanguageId(model, 1.0, usual, slack)
    entropy, n = np.array(rows.entropy.tolist()), rows.n.to_numpy()
    truth = np.array([model.languages.index(x) for x in rows.lang])
    losses = []
    options = 2.0 ** np.arange(-8, 1)
    for option in options:
        logits = -option * n[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
        losses.append(np.mean(np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(n)), truth]))
    for j in range(count):
        own = truth == j
        if own.any():
            usual[j] = np.average(entropy[own, j], weights=np.minimum(n[own], 1000))
            excess = (entropy[own, j] - usual[j]) / spread(n[own])
            slack[j] = max(2.0, 2.0 * np.quantile(excess, USUAL_SHARE, method="lower"))
    return LanguageId(model, float(options[int(np.argmin(losses))]), usual, slack)


def _predict(batches: Iterator[pa.RecordBatch], shared, carried: list[str]) -> Iterator[pa.RecordBatch]:
    found: LanguageId = shared.value
    names = np.array([*found.model.languages, UNKNOWN], dtype=object)
    for batch in batches:
        for part in slices(batch, most=SLICE):
            entropy, n, letter = cross_entropy(found.model, texts_of(part))
            best, score, rejected = found.decide(entropy, n)
            none = letter == 0
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in carried],
                    pa.array(names[np.where(none, -1, best)], pa.string()),
                    pa.array(np.where(none, 0.0, score)),
                    pa.array(rejected | none),
                ],
                names=[*carried, "lang_pred", "score", "rejected"],
            )


def identify(documents: DataFrame, fitted: LanguageId | None, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns of each input row with ``lang_pred``, ``score`` and ``rejected``.

    The language with the lowest cross-entropy per symbol wins; equal ones go to the
    first in code-point order. Letters are lower-cased, everything else only separates
    words. A null text or one without letters is ``und``, score 0, rejected; so is every
    row if there was nothing to learn from. ``rejected`` marks texts that even their
    best language explains far worse than its own; they keep their ``lang_pred``.
    Whole texts are read; repeated rows give repeated rows; no rows give none.
    """
    if fitted is None:
        return documents.select(*carried, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = documents.sparkSession.sparkContext.broadcast(fitted)
    rows = documents.select(*carried, "text") if "text" not in carried else documents.select(*carried)
    schema = T.StructType([rows.schema[c] for c in carried])
    schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())
    return rows.mapInArrow(lambda it: _predict(it, shared, list(carried)), schema)


def accepted(documents: DataFrame, fitted: LanguageId | None) -> DataFrame:
    """``documents`` without the rows that ``identify`` rejects."""
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")
    kept = identify(rows, fitted, ("row", "text")).where("not rejected")
    return kept.select(*[(F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in documents.columns])


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n
