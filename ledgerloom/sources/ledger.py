"""Purchase-ledger scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom import schemas


def normalise_ledger(raw: DataFrame) -> DataFrame:
    """Landed column names and types to the normalised ledger.

    Columns are found by name, so an unnamed index column or another column
    order does no harm. Absent optional columns are left out.
    """
    types = {field.name: field.dataType for field in schemas.LEDGER}
    required = ("ts", "group_desc", "rm_code", "price")
    found = {
        name: F.col(f"`{landed}`").cast(types[name]).alias(name)
        for landed, name in schemas.LEDGER_COLUMNS.items()
        if landed in raw.columns
    }
    absent = [name for name in required if name not in found]
    if absent:
        raise ValueError(f"ledger lacks {', '.join(absent)}")
    return raw.select(*found.values())


def read_ledger(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Landed ledger (CSV with a header, or a typed columnar format)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return normalise_ledger(reader.load(path))
