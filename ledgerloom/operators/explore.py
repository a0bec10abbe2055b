"""Exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.months import first_day, month_idx
from ledgerloom.operators.features import join_monthly
from ledgerloom.operators.scaling import safe_variance


def volume_by_year(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("rm_code", F.year("ts").alias("year")).agg(F.sum("weight").alias("volume"))


def volume_pivot(ledger: DataFrame, years: list[int]) -> DataFrame:
    """Codes x years; a year without purchases shows 0. Years come from config."""
    wide = volume_by_year(ledger.where(F.year("ts").isin(years)))
    pivoted = wide.groupBy("rm_code").pivot("year", years).agg(F.sum("volume"))
    return pivoted.select("rm_code", *[F.coalesce(f"`{y}`", F.lit(0.0)).alias(f"y{y}") for y in years])


def site_flags(ledger: DataFrame, sites: list[str]) -> DataFrame:
    """Daily price and volume per code and site, with one 0/1 column per site."""
    daily = ledger.groupBy("rm_code", "site", F.col("ts").cast("date").alias("date")).agg(
        F.sum("weight").alias("weight"), F.avg("price").alias("price")
    )
    return daily.withColumns({f"SITE_{s}": (F.col("site") == F.lit(s)).cast("int") for s in sites})


def volume_share(ledger: DataFrame, key: str) -> DataFrame:
    """Volume per key and its percentage of the total.

    The total is a scalar subquery over the per-key sums: no window gathers all
    keys in one task.
    """
    per_key = ledger.groupBy(key).agg(F.sum("weight").alias("volume"))
    total = per_key.agg(F.sum("volume").alias("total")).scalar()
    return per_key.withColumn("share_pct", F.try_divide(100 * F.col("volume"), total))


def codes_per_group(ledger: DataFrame) -> DataFrame:
    """Distinct codes per group, flagging the group with the most."""
    counts = codes_by_group(ledger).groupBy("group_desc").agg(F.count("rm_code").alias("n_codes"))
    most = counts.agg(F.max("n_codes").alias("most")).scalar()
    return counts.withColumn("is_max", F.col("n_codes") == most)


def complete_counts(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, rows with a null left out."""
    return ledger.na.drop("any").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def code_catalog(ledger: DataFrame) -> DataFrame:
    """Rows per group and code, rows with a null left out."""
    return complete_counts(ledger, ["group_desc", "rm_code"])


def codes_by_group(ledger: DataFrame) -> DataFrame:
    """The codes of each group as rows; a list per group would grow without bound."""
    return ledger.select("group_desc", "rm_code").distinct()


def monthly_indices(calendar_rows: DataFrame, names: list[str]) -> DataFrame:
    """Monthly mean of each index over a calendar joined with series."""
    return calendar_rows.groupBy(month_idx("date").alias("month_idx")).agg(
        F.min("date").alias("first_date"), *[F.avg(name).alias(name) for name in names]
    )


def two_level_panel(
    ledger: DataFrame, indices: DataFrame, names: list[str], n_months: int, months: Column | None = None
) -> DataFrame:
    """Day level, then month level, next to the monthly indices.

    Price is the mean of daily means, weight the sum; a month without purchases
    keeps a row with weight 0 and no price. ``indices`` has one row per month;
    ``months`` is the array of these months, if it can be had without reading the
    indices once more. The map per code holds months, so the calendar bounds it.
    """
    daily = ledger.groupBy("rm_code", F.col("ts").cast("date").alias("date")).agg(
        F.sum("weight").alias("weight"), F.avg("price").alias("price")
    )
    monthly = daily.groupBy("rm_code", month_idx("date").alias("month_idx")).agg(
        F.sum("weight").alias("weight"), F.avg("price").alias("price")
    )
    if months is None:
        months = indices.agg(F.collect_set("month_idx").alias("months")).scalar()
    entry = F.struct("month_idx", F.struct("weight", "price"))
    full = (
        monthly.groupBy("rm_code")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("known"))
        .select("rm_code", "known", F.explode(months).alias("month_idx"))
        .select("rm_code", "month_idx", F.try_element_at("known", F.col("month_idx")).alias("cell"))
        .select("rm_code", "month_idx", "cell.weight", "cell.price")
    )
    return join_monthly(full, indices, n_months).select(
        "rm_code",
        "month_idx",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        "price",
        *names,
        F.coalesce("first_date", first_day("month_idx")).alias("date"),
    )


def driver_correlation(panel: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of price with each index per code, nulls as 0.

    Null where price or index does not vary. ``is_best`` marks the index with the
    highest correlation (first listed on ties); a null one never is.
    """
    price = F.coalesce("price", F.lit(0.0))

    def varied(c):
        return F.nullif(safe_variance(F.avg(c), F.var_pop(c), F.count(c)), F.lit(0.0))

    def correlation(name: str):
        index = F.coalesce(name, F.lit(0.0))
        return F.covar_pop(index, price) / F.sqrt(varied(index) * varied(price))

    wide = panel.groupBy("rm_code").agg(*[correlation(n).alias(n) for n in names])
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    first_best = F.coalesce(*[F.when(F.col(n) == best, F.lit(n)) for n in names])
    rows = F.array(
        *[F.struct(F.lit(n).alias("driver"), F.col(n).alias("correlation")) for n in names]
    )
    return wide.select("rm_code", first_best.alias("best"), F.inline(rows)).select(
        "rm_code", "driver", "correlation", F.col("driver").eqNullSafe(F.col("best")).alias("is_best")
    )


def peak_shift_days(panel: DataFrame, names: list[str]) -> DataFrame:
    """Days from each index's peak to the price peak of each code; ties take the later date."""

    def peak(c: str):
        return F.max_by("date", F.when(F.col(c).isNotNull(), F.struct(c, "date")))

    peaks = panel.groupBy("rm_code").agg(
        peak("price").alias("price_peak"), *[peak(n).alias(n) for n in names]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("driver"), F.col(n).alias("driver_peak")) for n in names])
    return peaks.select("rm_code", "price_peak", F.inline(rows)).withColumn(
        "shift_days", F.datediff("price_peak", "driver_peak")
    )
