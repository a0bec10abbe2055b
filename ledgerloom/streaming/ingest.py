"""Incremental ingest: purchases arriving as files keep a monthly store current.

Each micro-batch is reduced to one row per code and month and written to its
own folder. Sums, counts and last prices of the folders combine to the same
months a batch run over all files gives, so raw rows are read once. Repeating a
batch after a lost driver overwrites its folder and changes nothing. A purchase
arriving late simply adds to its month.

Every few batches the folders so far are folded into one base, so a reader meets
one base and few batches however long the stream has run. A base counts from the
moment its number is appended to a small table; until then readers use the one
before, and a base that was cut off is simply written again.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.config import YearWindow
from ledgerloom.operators.panel import (
    calendar_months,
    months_of,
    price_moments,
    spread_months,
)


# Batches after which the store is folded into a new base.
FOLD_EVERY = 8


def _store_batch(batch: DataFrame, batch_id: int, root: str, fold_every: int = FOLD_EVERY) -> None:
    months = months_of(price_moments(batch)).drop("avg_price")
    months.write.mode("overwrite").parquet(f"{root}/months/batch={batch_id}")
    if (batch_id + 1) % fold_every == 0:
        fold(batch.sparkSession, root, batch_id)


def fold(spark: SparkSession, root: str, last: int) -> None:
    """Write the months of all batches up to ``last`` as a base and announce it."""
    if _base(spark, root) < last:
        stored_months(spark, root).drop("avg_price").write.mode("overwrite").parquet(f"{root}/bases/{last}")
        _announce(spark, root, last, "append")


def _announce(spark: SparkSession, root: str, last: int, mode: str) -> None:
    spark.range(1).select(F.lit(last).cast("long").alias("base")).write.mode(mode).parquet(f"{root}/announced")


def _base(spark: SparkSession, root: str) -> int:
    """Last batch of the newest announced base, -1 if there is none yet."""
    return spark.read.schema("base long").parquet(f"{root}/announced").agg(F.max("base")).first()[0]


def ingest(
    purchases: DataFrame, root: str, available_now: bool = True, fold_every: int = FOLD_EVERY
) -> StreamingQuery:
    """Start folding a stream of clean ledger rows into ``root``.

    Store and stream position live under the same root, so they cannot drift apart.
    How many files a batch takes is an option of the stream (``maxFilesPerTrigger``).
    """
    _announce(purchases.sparkSession, root, -1, "ignore")
    writer = purchases.writeStream.option("checkpointLocation", f"{root}/position").foreachBatch(
        partial(_store_batch, root=root, fold_every=fold_every)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stored_months(spark: SparkSession, root: str) -> DataFrame:
    """The months with purchases over all batches so far: the newest base and what came after."""
    base = _base(spark, root)
    stored = spark.read.parquet(f"{root}/months").where(F.col("batch") > base).drop("batch")
    if base >= 0:
        stored = stored.unionByName(spark.read.parquet(f"{root}/bases/{base}"))
    group = [c for c in ("group_desc",) if c in stored.columns]
    moments = stored.groupBy("rm_code", *group, "month_idx", "ts").agg(
        F.sum("total").alias("total"),
        F.sum("n_purchases").alias("n"),
        F.max("last_price").alias("top"),
    )
    return months_of(moments)


def stored_panel(spark: SparkSession, root: str, calendar: str | YearWindow = "observed") -> DataFrame:
    """Gap-filled panel over everything ingested so far."""
    months = stored_months(spark, root)
    return spread_months(months, calendar_months(months, calendar))
