"""Forecasts from stored LASSO models.

A fitted back-test becomes a table with a row per model: scales and weights as arrays
over one list of columns, zero weights where a horizon rules a column out. Such a table
is written once, read back and joined to feature rows by code. Scoring is arithmetic
over array elements inside code generation; no model is refitted and no Python runs.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.config import ForecastWindow
from ledgerloom.functions.metrics import mape
from ledgerloom.operators.split import in_test_windows, window_array

MODEL_KEYS = ["rm_code", "feature_set", "horizon", "test"]

STORED_SCHEMA = (
    "horizon int, test int, n_train int, n_test int, alpha double, cv_r2 double, y_mean double, y_scale double, "
    "active array<string>, weights array<double>, means array<double>, scales array<double>, columns array<string>, "
    "feature_set string"
)


def model_table(models: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Solved models of a back-test as rows of arrays, each as long as ``columns``.

    A column that a model does not know has weight 0 and null scales. ``active`` names
    the columns it knows.
    """
    names = list(columns)
    by_name = F.map_from_entries(
        F.transform("coefs", lambda c: F.struct(c["feature"], F.struct(c["coef"], c["mean"], c["scale"])))
    )

    def aligned(field: str) -> Column:
        return F.array(*[F.try_element_at("_known", F.lit(name))[field] for name in names])

    return (
        models.where("status = 'ok'")
        .withColumn("_known", by_name)
        .select(
            *MODEL_KEYS, "n_train", "n_test", "alpha", "cv_r2", "y_mean", "y_scale",
            F.transform("coefs", lambda c: c["feature"]).alias("active"),
            F.transform(aligned("coef"), lambda w: F.coalesce(w, F.lit(0.0))).alias("weights"),
            aligned("mean").alias("means"),
            aligned("scale").alias("scales"),
        )
    )


def write_models(table: DataFrame, path: str, columns: Iterable[str], mode: str = "overwrite") -> None:
    """Files by feature set; the order of ``columns`` is kept with the arrays."""
    listed = F.array(*map(F.lit, columns))
    table.withColumn("columns", listed).write.mode(mode).partitionBy("feature_set").parquet(path)


def read_models(spark: SparkSession, path: str, columns: Iterable[str], code_type: str = "string") -> DataFrame:
    """A written table, empty ones too; fails on reading a row whose arrays follow other columns."""
    kept = F.col("columns") == F.array(*map(F.lit, columns))
    table = spark.read.schema(f"rm_code {code_type}, {STORED_SCHEMA}").parquet(path)
    wrong = F.raise_error(F.concat(F.lit("models of other columns: "), F.array_join("columns", ",")))
    return table.withColumn("weights", F.when(kept, F.col("weights")).otherwise(wrong)).drop("columns")


def scored(columns: Iterable[str]) -> Column:
    """Forecast of a row that has a model's arrays beside its features."""
    terms = [
        F.when(F.col("weights")[j] != 0, F.col("weights")[j] * (F.col(f"`{c}`") - F.col("means")[j]) / F.col("scales")[j])
        for j, c in enumerate(columns)
    ]
    return F.col("y_mean") + F.col("y_scale") * reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])


def window_forecasts(
    models: DataFrame, features: DataFrame, windows: list[ForecastWindow], columns: Iterable[str]
) -> DataFrame:
    """A row per model and purchased month of its test window: actual beside predicted.

    Both sides meet by code and window; feature rows come once per window they fall in.
    """
    names = list(columns)
    ids = [c for c in ("group_desc", "month_idx", "ts") if c in features.columns]
    tested = in_test_windows(features.select("rm_code", *ids, "average_price", *names), windows)
    held = models.select(*MODEL_KEYS, "y_mean", "y_scale", "weights", "means", "scales")
    return tested.join(held, ["rm_code", "test"]).select(
        *MODEL_KEYS, *ids, F.col("average_price").alias("actual"), scored(names).alias("predicted")
    )


def latest_forecasts(models: DataFrame, features: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Every feature row, known price or not, by its code's models of the last window."""
    names = list(columns)
    by_model = Window.partitionBy("rm_code", "feature_set", "horizon").orderBy(F.desc("test"))
    last = models.withColumn("_place", F.row_number().over(by_model)).where("_place = 1")
    ids = [c for c in ("group_desc", "month_idx", "ts", "average_price") if c in features.columns]
    held = last.select(*MODEL_KEYS, "y_mean", "y_scale", "weights", "means", "scales")
    return features.select("rm_code", *ids, *names).join(held, "rm_code").select(
        *MODEL_KEYS, *ids, scored(names).alias("predicted")
    )


def forecast_errors(forecasts: DataFrame) -> DataFrame:
    """Error of each model over its forecasts, as the back-test reports it."""
    return forecasts.groupBy(*MODEL_KEYS).agg(
        F.count(F.lit(1)).alias("n_test"), (100 * mape("actual", "predicted")).alias("mape_pct")
    )


def optimality(
    models: DataFrame, features: DataFrame, windows: list[ForecastWindow], columns: Iterable[str]
) -> DataFrame:
    """How far each stored model is from solving its own problem, from the rows it was trained on.

    A LASSO solution leaves every used column with the residual correlation
    ``alpha * sign(weight)`` and every unused one with less than ``alpha``. ``violation``
    is the largest departure, ``scale_error`` that of the stored means and scales from
    those of the training rows, relative to the scale. The rows and the models of a code
    meet in one task; both are bounded, by the calendar and by horizons and windows.
    """
    names = list(columns)
    at = F.col("ts")
    known = F.filter(window_array(windows), lambda w: at < w["start"])
    code_type = features.schema["rm_code"].dataType.simpleString()
    rows = features.where("rm_code IS NOT NULL").select(
        "rm_code", F.col("average_price").cast("double").alias("y"),
        F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("x"),
        F.transform(known, lambda w: w["test"]).alias("tests"),
    )
    held = models.where("rm_code IS NOT NULL").select(
        F.col("rm_code").cast(code_type), *MODEL_KEYS[1:], "alpha", "y_mean", "y_scale", "weights", "means", "scales",
        F.size("active").alias("n_columns"),
    )
    # By count, as in the back-test: few bytes, much work.
    spark = features.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_code = [side.repartition(parts, "rm_code").groupBy("rm_code") for side in (rows, held)]
    return by_code[0].cogroup(by_code[1]).applyInArrow(
        _departures,
        f"rm_code {code_type}, feature_set string, horizon int, test int, n_train long, alpha double, n_columns int, "
        "violation double, scale_error double",
    )


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of numbers or of equally long lists, and where they are not null."""
    flat = pa.concat_arrays([c.flatten() if pa.types.is_list(c.type) else c for c in column.chunks])
    shape = (len(column), -1) if pa.types.is_list(column.type) else (len(column),)
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(shape), there.reshape(shape)


def _departures(rows: pa.Table, models: pa.Table) -> pa.Table:
    """Of one code: a row per model that has training rows. A mean leaves nulls out."""
    kept: dict[tuple, list] = {}
    if rows.num_rows and models.num_rows:
        (y, y_there), (x, x_there) = map(_numbers, (rows["y"], rows["x"]))
        (weights, _), (means, m_there), (scales, s_there) = (_numbers(models[c]) for c in ("weights", "means", "scales"))
        tests = rows["tests"].to_pylist()
        facts = models.drop_columns(["rm_code", "weights", "means", "scales"]).to_pylist()
        seen = {t: np.array([t in r for r in tests]) for t in {f["test"] for f in facts}}
        for f, w, mean, scale, given in zip(facts, weights, means, scales, m_there & s_there, strict=True):
            of = seen[f["test"]]
            if not of.any():
                continue
            there = x_there[of] & given
            z = np.where(there, (x[of] - mean) / scale, 0.0)
            fitted = f["y_mean"] + f["y_scale"] * np.where(w != 0, w * z, 0.0).sum(axis=1)
            rest = np.where(y_there[of], (y[of] - fitted) / f["y_scale"], 0.0)
            sums = np.array([rest @ z, (there & y_there[of][:, None]).sum(axis=0), z.sum(axis=0), there.sum(axis=0)])
            # A model that is stored twice is one, over its rows twice.
            one = kept.setdefault((f["feature_set"], f["horizon"], f["test"]), [0, 0.0, f, w])
            one[0], one[1] = one[0] + int(of.sum()), one[1] + sums
    out = []
    for (feature_set, horizon, test), (n, (left, n_left, off, n_off), f, w) in kept.items():
        left, off = left / np.maximum(n_left, 1), np.abs(off[n_off > 0] / n_off[n_off > 0])
        used = np.abs(left - f["alpha"] * np.sign(w))
        departure = np.where(w != 0, used, np.maximum(np.abs(left) - f["alpha"], 0.0))[(w == 0) | (n_left > 0)]
        out.append(
            (feature_set, horizon, test, n, f["alpha"], f["n_columns"], *(float(v.max()) if v.size else None for v in (departure, off)))
        )
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
    columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
    code = (rows if rows.num_rows else models)["rm_code"]
    listed = pa.array([code[0].as_py()] * len(out), code.type)
    return pa.table([listed, *columns], names=[*MODEL_KEYS, "n_train", "alpha", "n_columns", "violation", "scale_error"])
