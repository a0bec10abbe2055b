"""One query per operator, over the whole order tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ledgerloom.functions.metrics import log_price, unlog_price
from ledgerloom.functions.months import (
    calendar_parts,
    in_period,
    is_quarter_end,
    month_label,
    month_of,
    months_back,
    plain_label,
    year_of,
)
from ledgerloom.functions.rounding import round_columns, scaled_round, whole
from ledgerloom.operators import baseline, charts, clean, encode, explore, features, forecast, lasso, month_bits
from ledgerloom.operators import panel as panels
from ledgerloom.operators import network, pooled, quality, regress, scaling, split
from ledgerloom.config import JobRequest, LagWindow
from ledgerloom.plans import jobs, tables
from ledgerloom.plans.tables import DRIVERS, HORIZONS, LAGS, WINDOWS, YEARS, table
from ledgerloom.session import cut_lineage, shared_dir
from ledgerloom.sources import archive
from ledgerloom.sources import calendar as calendars
from ledgerloom.sources import drivers as series
from ledgerloom.sources import json_records, sinks, variant_records
from ledgerloom.streaming import by_code, ingest

Query = Callable[[SparkSession, str], DataFrame]

BRANDS = [f"Brand#{n}" for n in range(1, 26)]
SITES = [f"NATION_{n}" for n in range(25)]
YEAR_LIST = list(range(YEARS.first, YEARS.last + 1))
CUT = date(2000, 1, 1)
SHORT_LAGS = LagWindow(1, 3)
FLOOR_DAY = "1996-01-01"
SHIFT_DAYS = 45
ALPHA = 0.1
TOP_K = 20
CODE_BUCKETS = 16
# The driver of the models with two features, which SQL can follow.
PAIR_DRIVER = "URGENT"
SPLIT_SEED = 42
TEST_PERCENT = 30

LANDED_FILES = 10
TARGET = "promo"
REQUESTED = [1, 2, 3, 4, 5, 1_000_000_007]
REQUEST = {
    "external_driver_duration": {"start_year": str(YEARS.first), "end_year": str(YEARS.last)},
    "external_driver": ["urgent", "High"],
    "material_price_duration": {"start_year": str(YEARS.first), "end_year": str(YEARS.last)},
    "feature_duration": {"start_month": "1", "end_month": "4"},
    "material_price_file": "lineitem.parquet",
    "target": "GOODS",
    "rm_code": BRANDS,
}

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _panel(spark: SparkSession, sf_dir: str, code: str = "part") -> DataFrame:
    return panels.monthly_panel(tables.clean_purchases(spark, sf_dir, code))


def _brand_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the brand as material code: few codes, all months filled."""
    brand = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    bought = table(spark, sf_dir, "lineitem").join(brand, F.col("l_partkey") == F.col("p_partkey"))
    ledger = tables.as_purchases(bought.withColumn("l_partkey", F.col("brand")))
    return clean.clean_ledger(ledger, YEARS)


def _supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense codes with every lag of price and drivers: what the models train on."""
    return features.feature_matrix(
        _panel(spark, sf_dir, "supplier"), tables.driver_series(spark, sf_dir), DRIVERS, LAGS, YEARS
    )


def _supplier_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ar_matrix(_panel(spark, sf_dir, "supplier"), LAGS)


# Sources and sinks


@query
def scan_ledger(spark, sf_dir):
    return tables.full_ledger(spark, sf_dir)


@query
def driver_series(spark, sf_dir):
    return tables.driver_series(spark, sf_dir)


@query
def driver_archive(spark, sf_dir):
    """All series land in the archive and are read back by series and year."""
    path = _folder(spark, "archive")
    archive.land_series(tables.daily_drivers(spark, sf_dir).where("driver is not null"), path)
    return series.monthly_series(archive.read_archive(spark, path, tables.PRIORITIES.values(), YEARS))


@query
def driver_electricity(spark, sf_dir):
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month"))
        .agg(F.avg(whole("o_totalprice")).alias("Electricity"))
    )
    return series.clean_year_month(monthly, YEARS)


@query
def json_records_parse(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", json_records.ISO_MICROS)
    opened = F.concat(F.lit('[{"Time":"'), stamp, F.lit('","props":'), F.col("props"), F.lit("}]"))
    record = T.StructType(
        [
            T.StructField("Time", T.TimestampNTZType()),
            T.StructField("props", T.StructType([T.StructField("k", T.LongType())])),
        ]
    )
    bodies = events.select("event_id", opened.alias("body"))
    rows = json_records.parse_json_records(bodies, record)
    return rows.select("event_id", F.col("Time").alias("ts"), F.col("props.k").alias("k"))


@query
def json_records_variant(spark, sf_dir):
    """Every event as a body; six in ten are damaged, each in its own way, and come out with a reason."""
    events = table(spark, sf_dir, "events")
    stamp = F.concat(F.lit('"Time":"'), F.date_format("ts", json_records.ISO_MICROS), F.lit('"'))
    props = F.concat(F.lit('"props":'), F.col("props"))
    kind = F.col("event_id") % 10
    record = (
        F.when(kind == 0, F.concat(F.lit("{"), stamp, F.lit(",")))
        .when(kind == 2, F.concat(F.lit("{"), props, F.lit("}")))
        .when(kind == 3, F.concat(F.lit('{"Time":"n/a",'), props, F.lit("}")))
        .when(kind == 4, F.concat(F.lit("{"), stamp, F.lit(',"props":{"k":"none"}}')))
        .when(kind == 5, F.col("event_id").cast("string"))
        .otherwise(F.concat(F.lit("{"), stamp, F.lit(","), props, F.lit("}")))
    )
    body = F.when(kind == 1, record).otherwise(F.concat(F.lit("["), record, F.lit("]")))
    fields = {"time": ("$.Time", "timestamp_ntz"), "k": ("$.props.k", "long")}
    bodies = events.select("event_id", body.alias("body"))
    return variant_records.parse_variant_records(bodies, fields, ["time"]).drop(variant_records.RAW)


@query
def json_records_write(spark, sf_dir):
    ledger = tables.clean_purchases(spark, sf_dir, extra=["weight"])
    return json_records.to_json_records(
        ledger.select("rm_code", month_label("ts").alias("label"), "year", "month", "month_idx")
    )


@query
def calendar_dim(spark, sf_dir):
    return calendars.calendar_of(tables.purchases(spark, sf_dir))


@query
def ingest_incremental(spark, sf_dir):
    """The whole table lands as several files, arrives in several batches and is folded twice."""
    root = _folder(spark, "ingest")
    columns = ["l_partkey", "l_suppkey", "l_orderkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    table(spark, sf_dir, "lineitem").select(columns).repartition(LANDED_FILES).write.parquet(f"{root}/landed")
    landed = spark.read.parquet(f"{root}/landed").schema
    stream = spark.readStream.schema(landed).option("maxFilesPerTrigger", 2).parquet(f"{root}/landed")
    arriving = clean.clean_ledger(tables.as_purchases(stream), YEARS)
    ingest.ingest(arriving, root, fold_every=2).awaitTermination()
    return ingest.stored_panel(spark, root)


@query
def ingest_by_code(spark, sf_dir):
    """The table lands in files by order number; each batch rewrites the codes it brings, with their lags."""
    root = _folder(spark, "by-code")
    columns = ["l_partkey", "l_suppkey", "l_orderkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    landing = table(spark, sf_dir, "lineitem").select(columns).repartition(LANDED_FILES, "l_orderkey")
    landing.write.parquet(f"{root}/landed")
    landed = spark.read.parquet(f"{root}/landed").schema
    stream = spark.readStream.schema(landed).option("maxFilesPerTrigger", 4).parquet(f"{root}/landed")
    arriving = clean.clean_ledger(tables.as_purchases(stream), YEARS)
    by_code.ingest_by_code(arriving, root, YEARS, SHORT_LAGS, buckets=CODE_BUCKETS, fold_every=2).awaitTermination()
    return by_code.stored_features(spark, root)


# Projections and filters


@query
def clean_ledger(spark, sf_dir):
    ledger = tables.full_ledger(spark, sf_dir)
    return clean.clean_ledger(ledger, YEARS)


@query
def year_window(spark, sf_dir):
    ledger = tables.purchases(spark, sf_dir)
    middle = clean.in_years("ts", tables.YearWindow(1997, 1999))
    return ledger.where(middle).select("rm_code", "ts", "price", "weight")


@query
def train_test_windows(spark, sf_dir):
    """Purchases are combined per timestamp before each goes into its windows."""
    ledger = tables.clean_purchases(spark, sf_dir, extra=["weight"])
    moments = ledger.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    rows = split.train_test_rows(moments, WINDOWS)
    return rows.groupBy("test", "is_test").agg(
        F.sum("n").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum("weight").alias("weight"),
    )


@query
def code_filter(spark, sf_dir):
    request = tables.group_of_code(spark, sf_dir).where("group_desc = 'promo'")
    ledger = tables.clean_purchases(spark, sf_dir)
    return clean.only_codes_of(ledger, request).select("rm_code", "ts", "price")


@query
def one_hot_codes(spark, sf_dir):
    target = panels.monthly_target(panels.monthly_panel(_brand_ledger(spark, sf_dir)))
    hot = encode.one_hot_codes(target, BRANDS)
    plain = {brand: brand.replace("#", "_").lower() for brand in BRANDS}
    return hot.withColumnsRenamed(plain)


@query
def one_hot_dates(spark, sf_dir):
    days = calendars.calendar_of(tables.purchases(spark, sf_dir)).select("date")
    parts = calendar_parts("date")
    days = days.withColumns({name.upper(): parts[name] for name in parts})
    ranges = {
        "YEAR": YEAR_LIST,
        "QUARTER": range(1, 5),
        "MONTH": range(1, 13),
        "WEEK": range(1, 54),
        "DAY": range(1, 32),
    }
    for name, values in ranges.items():
        days = encode.one_hot(days, name, values)
    return days.drop(*ranges)


@query
def month_label_and_index(spark, sf_dir):
    ledger = tables.clean_purchases(spark, sf_dir)
    return ledger.groupBy("month_idx", month_label("ts").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def month_offset(spark, sf_dir):
    days = tables.purchases(spark, sf_dir).select(F.col("ts").cast("date").alias("date")).distinct()
    return days.select("date", *[months_back("date", i).alias(f"back_{i}") for i in LAGS.lags])


@query
def shift_series_days(spark, sf_dir):
    daily = tables.daily_drivers(spark, sf_dir)
    return series.shift_days(daily, SHIFT_DAYS, FLOOR_DAY)


@query
def horizon_prune(spark, sf_dir):
    matrix = _supplier_ar(spark, sf_dir)
    return features.prune_horizon(matrix, [], LAGS, 6)


@query
def interaction_terms(spark, sf_dir):
    matrix = features.ar_matrix(panels.monthly_panel(_brand_ledger(spark, sf_dir)), SHORT_LAGS)
    hot = encode.one_hot_codes(matrix, BRANDS)
    crossed = features.interaction_terms(hot, BRANDS, SHORT_LAGS)
    names = [f"{b}_{a}" for b in BRANDS for a in features.ar_names(SHORT_LAGS.lags)]
    return crossed.select(
        "rm_code",
        "month_idx",
        *[F.col(f"`{n}`").alias(n.replace("#", "_").lower()) for n in names],
    )


@query
def period_flag(spark, sf_dir):
    days = calendars.calendar_of(tables.purchases(spark, sf_dir))
    return days.select("date", in_period("date", (date(1998, 2, 23), date(2000, 3, 7))).alias("flag"))


@query
def calendar_parts_of_purchases(spark, sf_dir):
    ledger = tables.purchases(spark, sf_dir)
    parts = [part.alias(name) for name, part in calendar_parts("ts").items()]
    return ledger.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


@query
def quarter_end_points(spark, sf_dir):
    monthly = panels.monthly_avg_price(tables.clean_purchases(spark, sf_dir))
    dated = monthly.withColumns({"year": year_of("month_idx"), "month": month_of("month_idx")})
    points = dated.where(is_quarter_end("month"))
    return points.select(
        "rm_code",
        plain_label("year", "month").alias("year_month"),
        "avg_price",
    )


@query
def drop_incomplete(spark, sf_dir):
    lagged = features.ar_lags(_panel(spark, sf_dir), LAGS)
    complete = clean.complete_rows(lagged, features.ar_names(LAGS.lags))
    return complete.select("rm_code", "month_idx", "is_imputed", "AR_12")


@query
def base_category_rows(spark, sf_dir):
    monthly = panels.monthly_avg_price(_brand_ledger(spark, sf_dir))
    hot = encode.one_hot_codes(monthly, BRANDS[:-1])
    return encode.base_category(hot, BRANDS[:-1]).select("rm_code", "month_idx", "avg_price")


@query
def log_roundtrip(spark, sf_dir):
    ledger = tables.purchases(spark, sf_dir)
    back = unlog_price(log_price("price"))
    return ledger.select(
        "rm_code",
        "ts",
        scaled_round(log_price("price")).alias("log_price"),
        (F.abs(back / F.col("price") - 1) < 1e-9).alias("is_inverse"),
    )


# Panel


@query
def month_grid(spark, sf_dir):
    grid = panels.month_grid(tables.clean_purchases(spark, sf_dir))
    return grid.select("rm_code", year_of("month_idx").alias("year"), month_of("month_idx").alias("month"))


@query
def grid_left_facts(spark, sf_dir):
    return panels.grid_left_facts(tables.clean_purchases(spark, sf_dir))


@query
def missing_cells(spark, sf_dir):
    return panels.missing_cells(tables.clean_purchases(spark, sf_dir))


@query
def impute_ffill(spark, sf_dir):
    return panels.impute_ffill(tables.clean_purchases(spark, sf_dir))


@query
def monthly_avg_price(spark, sf_dir):
    monthly = panels.monthly_avg_price(tables.clean_purchases(spark, sf_dir))
    return monthly


@query
def monthly_last(spark, sf_dir):
    ledger = tables.clean_purchases(spark, sf_dir, extra=["weight"])
    return panels.monthly_last(ledger, ["price", "weight"])


@query
def monthly_target(spark, sf_dir):
    target = panels.monthly_target(_panel(spark, sf_dir))
    return tables.with_group(target, spark, sf_dir)


@query
def exclude_imputed(spark, sf_dir):
    ledger = tables.clean_purchases(spark, sf_dir)
    target = panels.monthly_target(panels.monthly_panel(ledger))
    bought = month_bits.only_bought(target, month_bits.month_bits(ledger, F.col("price").isNotNull()))
    return bought.select("rm_code", "month_idx", "ts", "average_price")


# Features


@query
def driver_ffill(spark, sf_dir):
    """Daily series on every calendar day, gaps filled forward inside the years."""
    days = calendars.calendar_of(tables.purchases(spark, sf_dir)).select("date")
    names = spark.createDataFrame([(d,) for d in DRIVERS], "driver string")
    cells = names.withColumn("days", days.agg(F.collect_list("date")).scalar())
    daily = tables.daily_drivers(spark, sf_dir)
    full = cells.select("driver", F.explode("days").alias("date")).join(daily, ["driver", "date"], "left")
    return series.clean_series(full, YEARS, block=F.year("date") * 12 + F.month("date"))


@query
def driver_panel(spark, sf_dir):
    return features.driver_panel(tables.driver_series(spark, sf_dir), DRIVERS)


@query
def driver_lags(spark, sf_dir):
    return features.driver_lags(tables.driver_series(spark, sf_dir), DRIVERS, LAGS, YEARS)


@query
def ar_lags(spark, sf_dir):
    lagged = features.ar_lags(_panel(spark, sf_dir), LAGS)
    names = ["price", *features.ar_names(LAGS.lags)]
    return lagged.select("rm_code", "month_idx", "is_imputed", *names)


@query
def feature_matrix(spark, sf_dir):
    drivers = tables.driver_series(spark, sf_dir)
    matrix = features.feature_matrix(_panel(spark, sf_dir), drivers, DRIVERS, LAGS, YEARS)
    return matrix


@query
def calendar_indices(spark, sf_dir):
    """Daily mean over all orders and monthly means per driver, from one pass over the orders."""
    days = calendars.calendar_of(tables.purchases(spark, sf_dir))
    cells = tables.daily_drivers(spark, sf_dir, totals=True)
    month = Window.partitionBy("driver", F.year("date"), F.month("date"))
    inside = F.year("date").between(YEARS.first, YEARS.last)
    cells = cells.withColumn("monthly", F.avg(F.when(inside, F.col("value"))).over(month))
    wide = cells.groupBy("date").agg(
        (F.sum("total") / F.sum("n")).alias("DAILY"),
        *[F.max(F.when(F.col("driver") == d, F.col("monthly"))).alias(d) for d in DRIVERS],
    )
    joined = days.select("date", "year", "month").join(wide, "date", "left")
    return calendars.spread_over_months(joined, DRIVERS)


@query
def residual_topk(spark, sf_dir):
    forecast = baseline.naive_shift_forecast(
        panels.monthly_avg_price(tables.clean_purchases(spark, sf_dir)), 1
    )
    return baseline.largest_errors(forecast, TOP_K, ["rm_code", "month_idx"])


# Exploration


def _weights(spark, sf_dir) -> DataFrame:
    """Weight per code, so that groups are joined to codes and not to purchases."""
    per_code = tables.purchases(spark, sf_dir).groupBy("rm_code").agg(F.sum("weight").alias("weight"))
    return tables.with_group(per_code, spark, sf_dir)


@query
def volume_by_year(spark, sf_dir):
    return explore.volume_by_year(tables.purchases(spark, sf_dir))


@query
def volume_pivot(spark, sf_dir):
    return explore.volume_pivot(tables.purchases(spark, sf_dir), YEAR_LIST)


@query
def site_flags(spark, sf_dir):
    ledger = tables.purchases(spark, sf_dir).join(tables.site_of_supplier(spark, sf_dir), "supplier_no")
    return explore.site_flags(ledger, SITES)


@query
def volume_share_group(spark, sf_dir):
    return round_columns(explore.volume_share(_weights(spark, sf_dir), "group_desc"), ["share_pct"])


@query
def volume_share_site(spark, sf_dir):
    per_supplier = (
        tables.purchases(spark, sf_dir).groupBy("supplier_no").agg(F.sum("weight").alias("weight"))
    )
    sited = per_supplier.join(tables.site_of_supplier(spark, sf_dir), "supplier_no")
    return round_columns(explore.volume_share(sited, "site"), ["share_pct"])


@query
def volume_share_code(spark, sf_dir):
    return round_columns(explore.volume_share(tables.purchases(spark, sf_dir), "rm_code"), ["share_pct"])


@query
def codes_per_group(spark, sf_dir):
    return explore.codes_per_group(_weights(spark, sf_dir))


@query
def code_catalog(spark, sf_dir):
    """Complete purchases are counted per code before the groups are joined."""
    per_code = explore.complete_counts(tables.purchases(spark, sf_dir), ["rm_code", "supplier_no"])
    sited = per_code.join(tables.site_of_supplier(spark, sf_dir).na.drop("any"), "supplier_no")
    grouped = sited.join(tables.group_of_code(spark, sf_dir).na.drop("any"), "rm_code")
    return grouped.groupBy("group_desc", "rm_code").agg(F.sum("n_rows").alias("n_rows"))


@query
def codes_by_group(spark, sf_dir):
    return explore.codes_by_group(_weights(spark, sf_dir))


@query
def distinct_group_of_codes(spark, sf_dir):
    return _weights(spark, sf_dir).select("group_desc").dropDuplicates()


def _exploration(spark, sf_dir) -> dict[str, DataFrame]:
    ledger = tables.clean_purchases(spark, sf_dir, extra=["weight"])
    days = calendars.calendar_of(ledger).select("date", "year", "month")
    joined = calendars.join_long(days, tables.daily_drivers(spark, sf_dir), DRIVERS)
    return jobs.exploration_plan(ledger, joined, DRIVERS, YEARS.n_months)


@query
def monthly_panel_two_level(spark, sf_dir):
    return round_columns(_exploration(spark, sf_dir)["panel"], ["price"])


@query
def driver_correlation(spark, sf_dir):
    return round_columns(_exploration(spark, sf_dir)["correlation"], ["correlation"])


@query
def peak_shift_days(spark, sf_dir):
    return _exploration(spark, sf_dir)["peak_shift"]


@query
def price_evolution(spark, sf_dir):
    filled = tables.with_group(_panel(spark, sf_dir), spark, sf_dir)
    return charts.price_evolution(filled)


# Baselines


@query
def naive_backtest(spark, sf_dir):
    scores = jobs.naive_plan(tables.purchases(spark, sf_dir), YEARS, LAGS, HORIZONS, WINDOWS)
    return round_columns(scores, ["mape_pct"], 4)


@query
def persistence_mape(spark, sf_dir):
    scores = baseline.persistence_mape(_supplier_ar(spark, sf_dir), HORIZONS, WINDOWS)
    return round_columns(scores, ["mape_pct"], 3)


@query
def naive_shift_forecast(spark, sf_dir):
    monthly = panels.monthly_avg_price(tables.clean_purchases(spark, sf_dir))
    forecast = baseline.naive_shift_forecast(monthly, 3)
    return forecast


@query
def forecast_errors(spark, sf_dir):
    monthly = panels.monthly_avg_price(tables.clean_purchases(spark, sf_dir))
    forecast = tables.with_group(baseline.naive_shift_forecast(monthly, 1), spark, sf_dir)
    errors = baseline.naive_errors(forecast, ["group_desc"])
    return round_columns(
        round_columns(errors, ["mape", "mape_pct", "mae", "r2"], 5), ["mse"], -4
    )


@query
def actual_vs_pred_long(spark, sf_dir):
    lagged = features.ar_matrix(_panel(spark, sf_dir), SHORT_LAGS)
    rows = charts.actual_vs_predicted(lagged, ["rm_code", "month_idx"], "average_price", "AR_1", CUT)
    return rows


# Models


@query
def standardize_train(spark, sf_dir):
    rows = split.train_test_rows(_supplier_ar(spark, sf_dir), WINDOWS)
    columns = ["average_price", "AR_1"]
    scored = scaling.standardize(rows, ["rm_code", "test"], columns, ~F.col("is_test"))
    trained = scored.where("average_price IS NOT NULL")
    return round_columns(trained.select("rm_code", "test", "month_idx", "is_test", *columns), columns)


@query
def robust_scale(spark, sf_dir):
    columns = ["average_price", "AR_1"]
    scaled = scaling.robust_scale(_supplier_ar(spark, sf_dir), ["rm_code"], columns)
    return round_columns(scaled.select("rm_code", "month_idx", *columns), columns)


@query
def hash_split(spark, sf_dir):
    rows = _panel(spark, sf_dir).select("rm_code", "month_idx", "is_imputed")
    return split.hash_split(rows, ["rm_code", "month_idx"], TEST_PERCENT, SPLIT_SEED)


@query
def lasso_univariate(spark, sf_dir):
    matrix = cut_lineage(_supplier_ar(spark, sf_dir))
    scores = lasso.lasso_single_lag(matrix, HORIZONS, WINDOWS, ALPHA)
    return round_columns(scores, ["beta", "mape_pct"], 5)


@query
def lasso_ar(spark, sf_dir):
    return lasso.train_ar(_supplier_ar(spark, sf_dir), LAGS, HORIZONS, WINDOWS).drop("coefs")


def _single_lags(spark, sf_dir) -> DataFrame:
    """The whole search, with one feature per horizon: the case that SQL can follow."""
    matrix = cut_lineage(_supplier_ar(spark, sf_dir))
    parts = [lasso.train_ar(matrix, LagWindow(h, h), [h], WINDOWS) for h in HORIZONS]
    return reduce(DataFrame.unionByName, parts)


@query
def lasso_search_single_lag(spark, sf_dir):
    """Folds, penalty choice, coefficient and error of the back-test with a single lag."""
    cells = _single_lags(spark, sf_dir)
    shown = cells.select(
        "rm_code", "horizon", "test", "n_train", "n_test", "status", "alpha", "cv_r2", "mape_pct",
        F.try_element_at("coefs", F.lit(1))["coef"].alias("coef"),
    )
    return round_columns(round_columns(shown, ["alpha", "cv_r2", "coef"], 5), ["mape_pct"], 4)


@query
def coef_export_single_lag(spark, sf_dir):
    """Coefficient file of the single-lag back-test, read back: a column per lag, null where it is not used."""
    names, path = features.ar_names(HORIZONS), _folder(spark, "coefficients")
    coefs = lasso.coefficients(_single_lags(spark, sf_dir), places=9)
    sinks.write_coefficients(sinks.coefficient_table(coefs, names, 9), path)
    return round_columns(sinks.read_coefficients(spark, path, names, "long"), names, 5)


@query
def backtest_matrix_single_lag(spark, sf_dir):
    """Mean error over the windows beside persistence, with lag 1 as the only feature."""
    scores = jobs.forecast_plan(cut_lineage(_supplier_ar(spark, sf_dir)), [], LagWindow(1, 1), [1], WINDOWS)
    return round_columns(scores, ["mape_pct"], 3)


def _shown(cells: DataFrame, names: Callable[[int], tuple[str, str]]) -> DataFrame:
    """A model per row with its two weights; ``names`` tells the features of a horizon."""
    by_name = F.map_from_entries(F.transform("coefs", lambda c: F.struct(c["feature"], c["coef"])))

    def weight(k: int):
        name = F.create_map(*[F.lit(x) for h in HORIZONS for x in (h, names(h)[k])])[F.col("horizon")]
        return F.try_element_at(by_name, name).alias(f"coef_{k + 1}")

    shown = cells.select(
        "rm_code", "horizon", "test", "n_train", "n_test", "status", "alpha", "cv_r2", "mape_pct", weight(0), weight(1)
    )
    return round_columns(round_columns(shown, ["alpha", "cv_r2", "coef_1", "coef_2"], 5), ["mape_pct"], 4)


@query
def lasso_search_two_lags(spark, sf_dir):
    """The search with two autoregressive features per horizon, which SQL can still follow."""
    matrix = cut_lineage(_supplier_ar(spark, sf_dir))
    parts = [lasso.train_ar(matrix, LagWindow(h, h + 1), [h], WINDOWS) for h in HORIZONS]
    return _shown(reduce(DataFrame.unionByName, parts), lambda h: (f"AR_{h}", f"AR_{h + 1}"))


def _lag_and_driver(matrix: DataFrame) -> DataFrame:
    parts = [lasso.train_all_features(matrix, [PAIR_DRIVER], LagWindow(h, h), [h], WINDOWS) for h in HORIZONS]
    return reduce(DataFrame.unionByName, parts)


@query
def lasso_search_with_driver(spark, sf_dir):
    """The search with one autoregressive feature and one driver per horizon."""
    cells = _lag_and_driver(cut_lineage(_supplier_features(spark, sf_dir)))
    return _shown(cells, lambda h: (f"{PAIR_DRIVER}_{h}", f"AR_{h}"))


PAIR_COLUMNS = [f"{name}_{h}" for h in HORIZONS for name in (PAIR_DRIVER, "AR")]


@query
def coef_export_with_driver(spark, sf_dir):
    """Coefficient file of these models, read back."""
    path = _folder(spark, "coefficients")
    coefs = lasso.coefficients(_lag_and_driver(cut_lineage(_supplier_features(spark, sf_dir))), places=9)
    sinks.write_coefficients(sinks.coefficient_table(coefs, PAIR_COLUMNS, 9), path)
    return round_columns(sinks.read_coefficients(spark, path, PAIR_COLUMNS, "long"), PAIR_COLUMNS, 5)


@query
def backtest_matrix_with_driver(spark, sf_dir):
    """Mean error over the windows: persistence, lag 1, lag 1 and a driver."""
    matrix = cut_lineage(_supplier_features(spark, sf_dir))
    return round_columns(jobs.forecast_plan(matrix, [PAIR_DRIVER], LagWindow(1, 1), [1], WINDOWS), ["mape_pct"], 3)


def _stored_forecasts(spark, sf_dir) -> DataFrame:
    """Models fitted, written, read again and applied to their test windows."""
    matrix, path = cut_lineage(_supplier_features(spark, sf_dir)), _folder(spark, "models")
    fitted = forecast.model_table(_lag_and_driver(matrix), PAIR_COLUMNS)
    forecast.write_models(fitted, path, PAIR_COLUMNS)
    return forecast.window_forecasts(forecast.read_models(spark, path, PAIR_COLUMNS, "long"), matrix, WINDOWS, PAIR_COLUMNS)


@query
def lasso_forecasts(spark, sf_dir):
    """A row per forecast of the stored models."""
    return round_columns(_stored_forecasts(spark, sf_dir), ["predicted"], 3)


@query
def lasso_actual_vs_predicted(spark, sf_dir):
    """The stored models' forecasts as a long, chart-ready frame."""
    ids = ["rm_code", "horizon", "test", "month_idx"]
    rows = charts.actual_vs_predicted(_stored_forecasts(spark, sf_dir), ids, "actual", "predicted", CUT)
    return round_columns(rows, ["value"], 3)


@query
def lasso_largest_errors(spark, sf_dir):
    """The stored models' worst forecasts."""
    found = _stored_forecasts(spark, sf_dir).withColumn("abs_error", F.abs(F.col("actual") - F.col("predicted")))
    rows = round_columns(found.drop("feature_set", "ts"), ["predicted", "abs_error"], 3)
    return rows.orderBy(F.desc("abs_error"), "rm_code", "horizon", "test", "month_idx").limit(TOP_K)


@query
def lasso_optimality(spark, sf_dir):
    """Whether each stored model with all features solves its own problem, by its training rows."""
    matrix, path = cut_lineage(_supplier_features(spark, sf_dir)), _folder(spark, "models")
    names = features.feature_names(DRIVERS, LAGS)
    fitted = lasso.backtest(matrix, DRIVERS, LAGS, HORIZONS, WINDOWS)
    forecast.write_models(forecast.model_table(fitted, names), path, names)
    found = forecast.optimality(forecast.read_models(spark, path, names, "long"), matrix, WINDOWS, names)
    return found.select(
        *forecast.MODEL_KEYS, "n_train", "n_columns",
        (F.col("violation") <= 1e-8).alias("is_optimal"), (F.col("scale_error") <= 1e-8).alias("has_its_scales"),
    )


@query
def backtest_cells(spark, sf_dir):
    """Which models were trained, on how many rows."""
    models = lasso.train_ar(_supplier_ar(spark, sf_dir), LAGS, HORIZONS, WINDOWS)
    return models.select("rm_code", "horizon", "test", "n_train", "n_test", "status")


@query
def lasso_all(spark, sf_dir):
    matrix = _supplier_features(spark, sf_dir)
    return lasso.train_all_features(matrix, DRIVERS, LAGS, HORIZONS, WINDOWS).drop("coefs")


@query
def backtest_matrix(spark, sf_dir):
    """Mean error over the windows per code, horizon and feature set, beside persistence."""
    return jobs.forecast_plan(_supplier_features(spark, sf_dir), DRIVERS, LAGS, HORIZONS, WINDOWS)


@query
def coef_export(spark, sf_dir):
    models = lasso.train_all_features(
        _supplier_features(spark, sf_dir), DRIVERS, LAGS, HORIZONS, WINDOWS
    )
    return sinks.coefficient_table(lasso.coefficients(models), features.feature_names(DRIVERS, LAGS))


@query
def pooled_lasso(spark, sf_dir):
    """One model for all codes on a random split, scored per code on either side."""
    panel = panels.monthly_panel(_brand_ledger(spark, sf_dir))
    matrix = features.feature_matrix(panel, tables.driver_series(spark, sf_dir), DRIVERS, LAGS, YEARS)
    hot = encode.one_hot_codes(cut_lineage(matrix), BRANDS)
    rows = split.hash_split(hot, ["rm_code", "month_idx"], TEST_PERCENT, SPLIT_SEED)
    columns = [*BRANDS, *features.feature_names(DRIVERS, LAGS)]
    model = pooled.fit_pooled(rows.where("not is_test"), columns, ["rm_code", "month_idx"])
    scored = model.predict(rows)
    return baseline.naive_errors(scored, ["rm_code", "is_test"], "average_price", "prediction")


@query
def pooled_lasso_two_features(spark, sf_dir):
    """The pooled model with one lag and one driver, which SQL can follow."""
    panel = panels.monthly_panel(_brand_ledger(spark, sf_dir))
    matrix = features.feature_matrix(panel, tables.driver_series(spark, sf_dir), DRIVERS, LAGS, YEARS)
    keys = ["rm_code", "month_idx"]
    rows = split.hash_split(cut_lineage(matrix), keys, TEST_PERCENT, SPLIT_SEED)
    model = pooled.fit_pooled(rows.where("not is_test"), ["AR_1", f"{PAIR_DRIVER}_1"], keys)
    errors = baseline.naive_errors(model.predict(rows), ["rm_code", "is_test"], "average_price", "prediction")
    errors = round_columns(round_columns(errors, ["mape", "r2"], 4), ["mape_pct"], 2)
    return round_columns(round_columns(errors, ["mae"], 1), ["mse"], -4)


@query
def tuned_regressor(spark, sf_dir):
    """Boosted trees tuned on the training rows, scored on the later ones."""
    matrix = cut_lineage(_supplier_ar(spark, sf_dir))
    names = features.ar_names(LAGS.lags)
    before = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    best = regress.tune(
        matrix.where(before), names, ["rm_code", "month_idx"], depths=[2, 3], rounds=[5], folds=3
    ).bestModel
    scored = regress.predict(best, matrix.where(~before))
    return baseline.naive_errors(scored, ["rm_code"], "average_price", "prediction")


NETWORK_ROUNDS = (5, 10, 15)


@query
def network_regressor(spark, sf_dir):
    """Neural networks on all features and a random split: searched, fitted, saved, loaded, scored per code and side."""
    matrix = cut_lineage(_supplier_features(spark, sf_dir))
    rows = split.hash_split(matrix, ["rm_code", "month_idx"], TEST_PERCENT, SPLIT_SEED)
    names = features.feature_names(DRIVERS, LAGS)
    model, _ = network.search(
        rows.where("not is_test"), names, ["rm_code", "month_idx"], _folder(spark, "blocks"), network.grid(rounds=NETWORK_ROUNDS)
    )
    path = _folder(spark, "network")
    model.save(spark, path)
    scored = network.load_network(spark, path).predict(rows)
    return baseline.naive_errors(scored, ["rm_code", "is_test"], "average_price", "prediction")


@query
def model_reload(spark, sf_dir):
    """Boosted trees on all features and a random split, saved and loaded again, per code and side."""
    matrix = cut_lineage(_supplier_features(spark, sf_dir))
    rows = split.hash_split(matrix, ["rm_code", "month_idx"], TEST_PERCENT, SPLIT_SEED)
    names, path = features.feature_names(DRIVERS, LAGS), _folder(spark, "model")
    train = rows.where("not is_test").select("rm_code", "month_idx", "average_price", *names)
    fitted = regress.tune(train, names, ["rm_code", "month_idx"], depths=[2], rounds=[3], folds=2).bestModel
    regress.save_model(fitted, path)
    scored = regress.predict(fitted, rows).withColumnRenamed("prediction", "fitted")
    scored = regress.predict(regress.load_model(path), scored.drop("features"))
    return scored.groupBy("rm_code", "is_test").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs("prediction") < 1e12).alias("n_finite"),
        F.count_if(F.col("prediction") != F.col("fitted")).alias("n_changed"),
    )


@query
def feature_sink_scan(spark, sf_dir):
    """The feature matrix written by group and read back."""
    drivers = tables.driver_series(spark, sf_dir)
    matrix = features.feature_matrix(_panel(spark, sf_dir), drivers, DRIVERS, LAGS, YEARS)
    path = _folder(spark, "features")
    sinks.write_features(tables.with_group(matrix, spark, sf_dir), path)
    return sinks.read_features(spark, path)


@query
def forecasts_by_code(spark, sf_dir):
    """Features and models stored by code and brought together as they lie: errors per model from the two tables."""
    name = f"by_code_{uuid.uuid4().hex}"
    for kind, frame in (("panel", _panel(spark, sf_dir, "supplier")), ("features", _supplier_features(spark, sf_dir))):
        sinks.write_by_code(frame, f"{name}_{kind}", f"{shared_dir(spark)}/{name}-{kind}", CODE_BUCKETS)
    matrix = sinks.read_by_code(spark, f"{name}_features")
    parts = [
        lasso.train_all_features(matrix, [PAIR_DRIVER], LagWindow(h, h), [h], WINDOWS, by_code=True) for h in HORIZONS
    ]
    fitted = forecast.model_table(reduce(DataFrame.unionByName, parts), PAIR_COLUMNS)
    sinks.write_by_code(fitted, f"{name}_models", f"{shared_dir(spark)}/{name}-models", CODE_BUCKETS)
    models = sinks.read_by_code(spark, f"{name}_models")
    errors = forecast.forecast_errors(forecast.window_forecasts(models, matrix, WINDOWS, PAIR_COLUMNS))
    return round_columns(errors.drop("feature_set"), ["mape_pct"], 4)


@query
def feature_scan_of_a_group(spark, sf_dir):
    """One group of the written matrix: the other groups' files are not opened."""
    matrix = tables.with_group(features.ar_matrix(_panel(spark, sf_dir), SHORT_LAGS), spark, sf_dir)
    path = _folder(spark, "features")
    sinks.write_features(matrix, path)
    return sinks.read_features(spark, path, TARGET)


@query
def quality_report(spark, sf_dir):
    """Checks of a feature run by the pass that writes it; the ledger is judged before its year filter."""
    per_code = quality.ledger_counts(tables.purchases(spark, sf_dir))
    grouped = per_code.join(tables.group_of_code(spark, sf_dir), "rm_code", "left")
    drivers = tables.driver_series(spark, sf_dir)
    plain = tables.clean_purchases(spark, sf_dir)
    watch = quality.Watch()
    panel = watch.frame(panels.monthly_panel(plain), "panel")
    matrix = features.feature_matrix(panel, drivers, DRIVERS, LAGS, YEARS)
    quality.check_feature_columns(matrix, DRIVERS, LAGS)
    marked = quality.with_bits(matrix, month_bits.month_bits(plain, F.col("price").isNotNull()))
    marked = watch.frame(marked, "features", quality.feature_checks(DRIVERS, LAGS)).drop("_bits")
    crossed = features.interaction_terms(encode.one_hot_codes(marked, [1]), [1], SHORT_LAGS)
    watch.frame(crossed, "interactions").write.parquet(_folder(spark, "matrix"))
    written = {
        "features": watch.found("features"),
        "matrix_of_panel": [("rows_added", max(watch.rows("features") - watch.rows("panel"), 0))],
        "interactions_of_matrix": [("rows_changed", abs(watch.rows("interactions") - watch.rows("features")))],
    }
    judged = quality.union_reports(
        {"ledger": quality.report_counts(grouped), "drivers": quality.driver_report(drivers, DRIVERS)}
    )
    return judged.unionByName(quality.report_rows(spark, written))


@query
def quality_findings(spark, sf_dir):
    """The ledger checks where they find something: suppliers as codes, part types as groups."""
    sold = tables.purchases(spark, sf_dir).join(tables.group_of_code(spark, sf_dir), "rm_code")
    ledger = sold.select(
        F.col("supplier_no").alias("rm_code"),
        "group_desc",
        F.when(F.col("weight") > 1, F.col("ts")).alias("ts"),
        F.when(F.col("weight") < 50, F.col("price") - 100_000).alias("price"),
    )
    return quality.ledger_report(ledger, REQUESTED, TARGET)


@query
def request_features(spark, sf_dir):
    """A job request end to end with all checks; driver names come in any case."""
    request = JobRequest.from_dict(REQUEST)
    sold = _brand_ledger(spark, sf_dir).withColumn("group_desc", F.lit("Goods"))
    drivers = series.clean_series(tables.daily_drivers(spark, sf_dir), YEARS)
    matrix = jobs.feature_plan(sold, drivers, request, check=True)
    return matrix.withColumnsRenamed({b: b.replace("#", "_").lower() for b in BRANDS})
