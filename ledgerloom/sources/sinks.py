"""Feature and coefficient sinks, and the typed feature scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by group, so reading one group prunes the others.

    Rows are spread by group and code: the files of a large group stay many.
    """
    features.repartition("group_desc", "rm_code").write.mode(mode).partitionBy(
        "group_desc"
    ).parquet(path)


def write_features_csv(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV folder per group, with a header and no index column."""
    features.repartition("group_desc", "rm_code").write.mode(mode).partitionBy(
        "group_desc"
    ).option("header", True).csv(path)


def read_features(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    features = spark.read.parquet(path)
    return features if group is None else features.where(F.col("group_desc") == group)


def write_by_code(features: DataFrame, table: str, path: str, buckets: int, mode: str = "overwrite") -> None:
    """A table at ``path`` whose files hold whole codes, ordered by code and month.

    Whatever groups, orders or joins by code reads it without a shuffle, also together
    with other tables of as many buckets. One file per bucket; a code's rows are bounded
    by the calendar, so buckets are as even as the codes are many.
    """
    order = [c for c in ("month_idx", "ts") if c in features.columns][:1]
    (
        features.repartition(buckets, "rm_code")
        .write.mode(mode)
        .bucketBy(buckets, "rm_code")
        .sortBy("rm_code", *order)
        .option("path", path)
        .saveAsTable(table)
    )


def read_by_code(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.table(table)


def coefficient_table(coefs: DataFrame, features: list[str], places: int = 5) -> DataFrame:
    """Long ``(rm_code, horizon, test, feature, coef)`` to one row per model.

    A feature the horizon rules out stays null. The column list comes from the
    configuration, so no extra pass looks for distinct features.
    """
    return (
        coefs.groupBy("rm_code", "horizon", "test")
        .pivot("feature", features)
        .agg(F.round(F.first("coef"), places))
    )


def read_coefficients(spark: SparkSession, path: str, features: list[str], code_type: str = "string") -> DataFrame:
    """A written coefficient table with its types; columns by their order in the file."""
    coefs = ", ".join(f"`{name}` double" for name in features)
    schema = f"rm_code {code_type}, horizon int, test int, {coefs}"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_coefficients(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).option("header", True).csv(path)
