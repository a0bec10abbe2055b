"""Moments of expanding training sets from calendar segments.

The starts of the test windows cut a code's rows into segments. One aggregation gives
each segment's size, means and central moments; running totals over the few segments of
a code give every training set at once. No row is looked at once per window, and the
aggregation buffer does not grow with the number of windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.config import ForecastWindow


def _starts(windows: list[ForecastWindow]) -> list:
    return sorted({ForecastWindow.of(w).start for w in windows})


def segment_of(windows: list[ForecastWindow], ts: str = "ts") -> Column:
    """How many window starts a row has reached."""
    reached = [(F.col(ts) >= F.lit(s).cast("timestamp_ntz")).cast("int") for s in _starts(windows)]
    return reduce(Column.__add__, reached)


def segment_moments(df: DataFrame, pairs: dict[str, tuple[str, str]], windows: list[ForecastWindow]) -> DataFrame:
    """Per code and segment: ``n`` and, for each named ``(x, y)``, means, variances and covariance.

    Rows with a null among the columns or without a code or time are left out.
    """
    columns = sorted({c for pair in pairs.values() for c in pair})
    rows = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("rm_code", "ts", *columns)]))
    return rows.groupBy("rm_code", segment_of(windows).alias("segment")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.var_pop(c).alias(f"var_{c}") for c in columns],
        *[F.covar_pop(x, y).alias(f"covar_{name}") for name, (x, y) in pairs.items()],
    )


def training_moments(df: DataFrame, pairs: dict[str, tuple[str, str]], windows: list[ForecastWindow]) -> DataFrame:
    """The same columns per code and ``test``, over all rows before the window starts.

    Segments are joined around the code's own means: their differences are of the size
    of the data's spread, so nothing cancels. A window with no rows before it has no row.
    """
    starts, listed = _starts(windows), [ForecastWindow.of(w) for w in windows]
    columns = sorted({c for pair in pairs.values() for c in pair})
    code = Window.partitionBy("rm_code")
    so_far = code.orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moments = segment_moments(df, pairs, windows)
    centred = moments.withColumns({f"mid_{c}": F.sum(F.col("n") * F.col(f"mean_{c}")).over(code) / F.sum("n").over(code) for c in columns})
    off = {c: F.col(f"mean_{c}") - F.col(f"mid_{c}") for c in columns}

    def total(value: Column) -> Column:
        return F.sum(F.col("n") * value).over(so_far)

    sums = centred.select(
        "rm_code", "segment", *[f"mid_{c}" for c in columns],
        F.lead("segment").over(code.orderBy("segment")).alias("_next"),
        F.sum("n").over(so_far).alias("n"),
        *[total(off[c]).alias(f"d_{c}") for c in columns],
        *[total(F.col(f"var_{c}") + off[c] * off[c]).alias(f"v_{c}") for c in columns],
        *[total(F.col(f"covar_{name}") + off[x] * off[y]).alias(f"c_{name}") for name, (x, y) in pairs.items()],
    )
    places = F.array(
        *[F.struct(F.lit(k).alias("test"), F.lit(starts.index(w.start) + 1).alias("place")) for k, w in enumerate(listed, 1)]
    )
    # A code's running total holds up to its next segment; windows starting there are trained on it.
    held = F.filter(
        places, lambda w: (w["place"] > F.col("segment")) & (w["place"] <= F.coalesce(F.col("_next"), F.lit(len(starts))))
    )
    n = F.col("n")
    return sums.withColumn("_w", F.explode(held)).select(
        "rm_code", F.col("_w.test").alias("test"), "n",
        *[(F.col(f"mid_{c}") + F.col(f"d_{c}") / n).alias(f"mean_{c}") for c in columns],
        *[F.greatest(F.col(f"v_{c}") / n - F.pow(F.col(f"d_{c}") / n, F.lit(2)), F.lit(0.0)).alias(f"var_{c}") for c in columns],
        *[
            (F.col(f"c_{name}") / n - F.col(f"d_{x}") * F.col(f"d_{y}") / (n * n)).alias(f"covar_{name}")
            for name, (x, y) in pairs.items()
        ],
    )
