"""Index series that have landed, kept in folders by series and year.

A read names series and years; both are partition columns, so folders of other series and
years are not listed as input. Files are Spark's own, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.config import YearWindow
from ledgerloom.sources.drivers import clean_series

SCHEMA = "date date, value double, driver string, year int"


def land_series(series: DataFrame, path: str) -> None:
    """Add ``(driver, date, value)`` to the archive; years of a series that land again are replaced.

    Only those folders are rewritten. Rows without a series or date have no folder and
    end the job. A series' year is spread over as many tasks as its months.
    """
    absent = F.col("driver").isNull() | F.col("date").isNull()
    known = F.when(absent, F.raise_error(F.lit("a series value without series or date")).cast("date")).otherwise(F.col("date"))
    rows = series.select(known.alias("date"), F.col("value").cast("double").alias("value"), "driver", F.year("date").alias("year"))
    spread = rows.repartition("driver", "year", F.month("date"))
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("driver", "year").parquet(path)


def read_archive(
    spark: SparkSession, path: str, drivers: Iterable[str], years: YearWindow, block: Column | None = None
) -> DataFrame:
    """Series of the archive inside the years, gaps filled forward (``clean_series``).

    A series that never landed gives no rows; the checks of a request report it.
    """
    wanted = F.col("driver").isin(list(drivers)) & F.col("year").between(years.first, years.last)
    rows = spark.read.schema(SCHEMA).parquet(path).where(wanted)
    return clean_series(rows.select("driver", "date", "value"), years, block)
