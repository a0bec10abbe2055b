"""The order tables seen as a purchase ledger and its price drivers.

A line item is a purchase: its part (or supplier) is the material code, its unit
price the price, its ship date the posting date. Order totals per priority stand
in for external index series.

Unit prices are whole cents and daily index values whole currency units. Sums of
whole numbers are exact in doubles, so means do not depend on the order in which
partitions are added up.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.config import LagWindow, YearWindow, half_years
from ledgerloom.functions.rounding import whole
from ledgerloom.operators.clean import clean_ledger
from ledgerloom.sources.drivers import clean_series, monthly_series

YEARS = YearWindow(1995, 2001)
LAGS = LagWindow(1, 12)
HORIZONS = [1, 3, 6]
WINDOWS = half_years(date(1997, 1, 1), 10)

# The order priorities, as driver names.
PRIORITIES = {
    "1-URGENT": "URGENT",
    "2-HIGH": "HIGH",
    "3-MEDIUM": "MEDIUM",
    "4-NOT SPECIFIED": "UNSPECIFIED",
    "5-LOW": "LOW",
}
DRIVERS = list(PRIORITIES.values())

CODE_COLUMNS = {"part": "l_partkey", "supplier": "l_suppkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_purchases(lineitem: DataFrame, code: str = "part") -> DataFrame:
    return lineitem.select(
        F.col(CODE_COLUMNS[code]).alias("rm_code"),
        F.col("l_shipdate").alias("ts"),
        whole(100 * F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("weight"),
        F.col("l_suppkey").alias("supplier_no"),
        F.col("l_orderkey").alias("purchase_no"),
    )


def purchases(spark: SparkSession, sf_dir: str, code: str = "part") -> DataFrame:
    return as_purchases(table(spark, sf_dir, "lineitem"), code)


def group_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part belongs to one group, its type."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rm_code"), F.lower("p_type").alias("group_desc")
    )


def site_of_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier ships from one site, its nation."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("site"))
    supplier = table(spark, sf_dir, "supplier")
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    return joined.select(F.col("s_suppkey").alias("supplier_no"), "site")


def full_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with group and site on every row."""
    return (
        purchases(spark, sf_dir)
        .join(group_of_code(spark, sf_dir), "rm_code")
        .join(site_of_supplier(spark, sf_dir), "supplier_no")
        .select("ts", "group_desc", "rm_code", "price", "weight", "site", "supplier_no", "purchase_no")
    )


def clean_purchases(spark: SparkSession, sf_dir: str, code: str = "part", extra=()) -> DataFrame:
    return clean_ledger(purchases(spark, sf_dir, code), YEARS, extra)


def with_group(per_code: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the group after aggregation, when only a row per code and month is left."""
    return per_code.join(group_of_code(spark, sf_dir), "rm_code")


def daily_drivers(spark: SparkSession, sf_dir: str, totals: bool = False) -> DataFrame:
    """Daily mean order value per priority, on demand with total and number of orders."""
    extra = [F.sum(whole("o_totalprice")).alias("total"), F.count("o_totalprice").alias("n")]
    orders = table(spark, sf_dir, "orders")
    names = F.create_map(*[F.lit(part) for pair in PRIORITIES.items() for part in pair])
    return orders.groupBy(
        F.try_element_at(names, F.col("o_orderpriority")).alias("driver"),
        F.col("o_orderdate").cast("date").alias("date"),
    ).agg(whole(F.avg("o_totalprice")).alias("value"), *(extra if totals else []))


def driver_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly drivers, long."""
    return monthly_series(clean_series(daily_drivers(spark, sf_dir), YEARS))
