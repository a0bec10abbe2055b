"""Event-grain purchases to a gap-filled monthly panel.

A month without a purchase takes the price of the last purchase before it.
Gaps are never found by joining a grid: one ``lead`` over the months that do
have purchases tells how far each price carries, and ``explode`` writes those
months out. Raw rows are shuffled once, already combined per code and timestamp:
with dates that is a row per day, with times of day hardly fewer rows than before.

The calendar is the set of observed years times the set of observed months of
the whole ledger. It enters as a scalar subquery: one array of at most twelve
entries per year, whatever the size of the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.config import YearWindow
from ledgerloom.functions.months import mid_month, month_of, year_of
from ledgerloom.operators.month_bits import absent_months, month_bits

KEYS = ["rm_code", "month_idx"]


def calendar_months(ledger: DataFrame, calendar: str | YearWindow = "observed") -> Column:
    """Sorted array of the months a panel covers.

    ``"observed"``: observed years x observed months of year. ``"span"``: every
    month from the first to the last. A ``YearWindow``: every month of its years.
    """
    if isinstance(calendar, YearWindow):
        return F.sequence(F.lit(calendar.first * 12), F.lit(calendar.last * 12 + 11))
    if calendar == "span":
        ends = ledger.agg(F.sequence(F.min("month_idx"), F.max("month_idx")).alias("months"))
        return ends.scalar()
    if calendar != "observed":
        raise ValueError(f"unknown calendar {calendar!r}")
    seen = ledger.agg(
        F.collect_set(year_of("month_idx")).alias("years"),
        F.collect_set(month_of("month_idx")).alias("months"),
    )
    every = F.flatten(
        F.transform("years", lambda y: F.transform("months", lambda m: y * 12 + m - 1))
    )
    return seen.select(F.array_sort(every).alias("months")).scalar()


def _group_key(df: DataFrame) -> list[str]:
    return ["group_desc"] if "group_desc" in df.columns else []


def price_moments(ledger: DataFrame) -> DataFrame:
    """Purchases combined per code, month and timestamp."""
    return ledger.groupBy("rm_code", *_group_key(ledger), "month_idx", "ts").agg(
        F.sum("price").alias("total"), F.count("price").alias("n"), F.max("price").alias("top")
    )


def months_of(moments: DataFrame) -> DataFrame:
    """Months with purchases from moments: mean, last price, last timestamp, row count."""
    return (
        moments.where("n > 0")
        .groupBy("rm_code", *_group_key(moments), "month_idx")
        .agg(
            F.sum("total").alias("total"),
            F.sum("n").alias("n_purchases"),
            F.max_by("top", "ts").alias("last_price"),
            F.max("ts").alias("ts"),
        )
        .withColumn("avg_price", F.col("total") / F.col("n_purchases"))
    )


def monthly_prices(ledger: DataFrame) -> DataFrame:
    """Months with purchases: mean price, last price, last timestamp, row count.

    The last price is that of the latest timestamp, the highest price among
    equal timestamps. Both steps combine on the map side in fixed-width hash
    buffers, so a code holding a third of all rows shrinks before it is shuffled.
    """
    return months_of(price_moments(ledger))


def monthly_avg_price(ledger: DataFrame) -> DataFrame:
    keys = ["rm_code", *_group_key(ledger), "month_idx"]
    return ledger.groupBy(*keys).agg(F.avg("price").alias("avg_price"))


def spread_months(months: DataFrame, calendar: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Gap-filled panel from months with purchases (``monthly_prices``).

    ``within`` names columns that follow from the code: they are kept, and rows that are
    already partitioned by them stay where they are.
    """
    by_code = Window.partitionBy(*within, "rm_code").orderBy("month_idx")
    group = [*_group_key(months), *within]
    end = F.greatest(F.array_max("calendar"), F.col("month_idx")) + 1
    bought = months.withColumn("calendar", calendar).withColumn(
        "until", F.coalesce(F.lead("month_idx").over(by_code), end)
    )
    cells = bought.select(
        "rm_code",
        *group,
        F.col("month_idx").alias("bought_in"),
        "avg_price",
        "last_price",
        F.col("ts").alias("bought_ts"),
        "n_purchases",
        "calendar",
        F.explode(F.sequence(F.col("month_idx"), F.col("until") - 1)).alias("month_idx"),
    ).where(F.array_contains("calendar", F.col("month_idx")))
    carried = F.col("month_idx") != F.col("bought_in")
    return cells.select(
        "rm_code",
        *group,
        "month_idx",
        F.when(carried, mid_month("month_idx")).otherwise(F.col("bought_ts")).alias("ts"),
        F.when(carried, F.col("last_price")).otherwise(F.col("avg_price")).alias("price"),
        F.when(carried, F.lit(0)).otherwise(F.col("n_purchases")).alias("n_purchases"),
        carried.alias("is_imputed"),
    )


def monthly_panel(
    ledger: DataFrame, calendar: str | YearWindow = "observed", codes: list | None = None
) -> DataFrame:
    """One row per code and month from the code's first purchase on.

    The calendar always comes from the whole ledger, also when only some codes
    are asked for.
    """
    months = calendar_months(ledger, calendar)
    wanted = ledger if codes is None else ledger.where(F.col("rm_code").isin(list(codes)))
    return spread_months(monthly_prices(wanted), months)


def month_grid(ledger: DataFrame, calendar: str | YearWindow = "observed") -> DataFrame:
    """Every code in every calendar month."""
    codes = ledger.select("rm_code").distinct()
    return codes.withColumn("month_idx", F.explode(calendar_months(ledger, calendar)))


def missing_cells(ledger: DataFrame, calendar: str | YearWindow = "observed") -> DataFrame:
    """Grid cells without a priced purchase; ``is_leading`` marks those before the first.

    A code without any price misses every cell. Rows without a month stand in no cell.
    """
    bits = month_bits(ledger, F.col("price").isNotNull())
    return absent_months(bits, calendar_months(ledger, calendar))


def grid_left_facts(ledger: DataFrame, calendar: str | YearWindow = "observed") -> DataFrame:
    """The grid with its purchases: all purchase rows, and empty cells with null.

    Same rows as a left join of the grid to the ledger, but the ledger itself is
    not shuffled: only the cells it lacks are computed and appended.
    """
    facts = ledger.select(*KEYS, "ts", "price")
    empty = absent_months(month_bits(ledger), calendar_months(ledger, calendar)).select(
        *KEYS, F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("price")
    )
    return facts.unionByName(empty)


def impute_ffill(ledger: DataFrame, calendar: str | YearWindow = "observed") -> DataFrame:
    """Purchase rows as they are, plus one row per filled month (on its 15th)."""
    columns = ["rm_code", *_group_key(ledger), "month_idx", "ts", "price"]
    filled = monthly_panel(ledger, calendar).where("is_imputed")
    return (
        ledger.where(F.col("price").isNotNull())
        .select(*columns, F.lit(False).alias("is_imputed"))
        .unionByName(filled.select(*columns, "is_imputed"))
    )


def monthly_last(ledger: DataFrame, columns: list[str]) -> DataFrame:
    """Last timestamp of each code and month, with the values at that moment.

    Among rows of the same moment the highest value of each column counts.
    """
    moments = ledger.groupBy(*KEYS, "ts").agg(*[F.max(c).alias(c) for c in columns])
    return moments.groupBy(*KEYS).agg(
        F.max("ts").alias("last_ts"),
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"last_{c}")
            for c in columns
        ],
    )


def monthly_target(panel: DataFrame) -> DataFrame:
    """Panel as the target table: last moment and mean price of each month."""
    return panel.select(
        "rm_code",
        *_group_key(panel),
        year_of("month_idx").alias("year"),
        month_of("month_idx").alias("month"),
        "month_idx",
        "ts",
        F.col("price").alias("average_price"),
        "is_imputed",
    )


def exclude_imputed(df: DataFrame, missing: DataFrame) -> DataFrame:
    """Drop the months of each code that had no purchase."""
    return df.join(missing.select(*KEYS), KEYS, "left_anti")
