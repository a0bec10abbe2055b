"""JSON record arrays to rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def parse_json_records(
    bodies: DataFrame, record: T.StructType, date_col: str = "Time", body: str = "body"
) -> DataFrame:
    """Each body is a JSON array of records; one row per record.

    The date column must be in the record type. A body that is null or not JSON,
    and a record whose date is absent or unreadable, fail the job.
    """
    if date_col not in record.fieldNames():
        raise ValueError(f"column {date_col!r} not found in the record type")
    as_text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == date_col else f.dataType)
            for f in record
        ]
    )
    others = [c for c in bodies.columns if c != body]
    given = F.coalesce(F.col(body), F.raise_error(F.lit(f"null body in column {body}")).cast("string"))
    records = F.from_json(given, T.ArrayType(as_text), {"mode": "FAILFAST"})
    day = F.col(date_col)
    dated = F.when(day.isNull(), F.raise_error(F.lit(f"null date in column {date_col}"))).otherwise(
        day.cast("timestamp_ntz")
    )
    return bodies.select(*others, F.inline(records)).withColumn(date_col, dated)


def to_json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON object per row, timestamps in ISO form, absent values kept as null."""
    options = {"ignoreNullFields": "false", "timestampNTZFormat": ISO_MICROS}
    return df.select(F.to_json(F.struct(*df.columns), options).alias(name))
