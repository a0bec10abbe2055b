"""Train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import ForecastWindow


def window_array(windows: list[ForecastWindow]) -> Column:
    """The test windows as one literal array, numbered from 1."""
    return F.array(
        *[
            F.struct(
                F.lit(number).alias("test"),
                F.lit(w.start).cast("timestamp_ntz").alias("start"),
                F.lit(w.end).cast("timestamp_ntz").alias("end"),
            )
            for number, w in enumerate(map(ForecastWindow.of, windows), start=1)
        ]
    )


def in_test_windows(df: DataFrame, windows: list[ForecastWindow], ts: str = "ts") -> DataFrame:
    """Rows in ``[start, end)``, once per window they fall in, as column ``test``.

    The windows are a literal, so no join and no shuffle is involved.
    """
    at = F.col(ts)
    hits = F.filter(window_array(windows), lambda w: (at >= w["start"]) & (at < w["end"]))
    return df.withColumn("test", F.explode(F.transform(hits, lambda w: w["test"])))


def train_test_rows(df: DataFrame, windows: list[ForecastWindow], ts: str = "ts") -> DataFrame:
    """Every row before a window's end, once per window, flagged ``is_test``."""
    at = F.col(ts)
    hits = F.filter(window_array(windows), lambda w: at < w["end"])
    return (
        df.withColumn("_w", F.explode(hits))
        .withColumns({"test": F.col("_w.test"), "is_test": at >= F.col("_w.start")})
        .drop("_w")
    )


def hash_split(df: DataFrame, keys: list[str], test_percent: int, seed: int) -> DataFrame:
    """Flag a fixed share of rows as test by a digest of their key.

    The same row always lands on the same side, however the data is partitioned.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("is_test", bucket < test_percent)
