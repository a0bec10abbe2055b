"""Bought months as bits: membership, gaps, and what the plans no longer join."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, month
from ledgerloom.config import LagWindow, YearWindow
from ledgerloom.operators import month_bits as B
from ledgerloom.operators import panel as P
from ledgerloom.operators import quality as Q
from ledgerloom.plans import tables
from ledgerloom.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def random_book(spark):
    """Codes over 30 years, some without any price, one without a month, single months at both ends of a word."""
    rng = random.Random(2)
    rows = []
    for code in range(12):
        for m in rng.sample(range(1990 * 12, 2020 * 12), rng.randrange(1, 120)):
            rows.append((code, m, None if code == 3 or rng.random() < 0.2 else 1.0))
    rows += [(50, 64 * 374, 1.0), (51, 64 * 374 + 63, 1.0), (51, 64 * 375, 1.0), (52, None, 1.0), (None, 64 * 374, 1.0)]
    return spark.createDataFrame(rows, "rm_code long, month_idx int, price double"), rows


def test_bits_are_the_bought_months(random_book, spark):
    book, rows = random_book
    months = spark.range(1990 * 12 - 70, 2020 * 12 + 70).select(F.col("id").cast("int").alias("month_idx"))
    bits = B.month_bits(book, F.col("price").isNotNull())
    got = months.join(bits, how="cross").where(B.is_bought()).select("rm_code", "month_idx").collect()
    wanted = {(c, m) for c, m, p in rows if p is not None and m is not None}
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)
    firsts = {r["rm_code"]: r["first_month"] for r in bits.collect()}
    assert set(firsts) == {c for c, _, _ in rows}
    for code in firsts:
        assert firsts[code] == min((m for c, m in wanted if c == code), default=None)


def test_absent_months_equal_a_grid(random_book):
    book, rows = random_book
    calendar = F.sequence(F.lit(1990 * 12), F.lit(2019 * 12 + 11))
    bits = B.month_bits(book, F.col("price").isNotNull())
    got = {tuple(r) for r in B.absent_months(bits, calendar).collect()}
    bought = {(c, m) for c, m, p in rows if p is not None and m is not None}
    wanted = set()
    for code in {c for c, _, _ in rows}:
        first = min((m for c, m in bought if c == code), default=None)
        wanted |= {(code, m, first is None or m < first) for m in range(1990 * 12, 2020 * 12) if (code, m) not in bought}
    assert got == wanted


def test_only_bought_equals_the_anti_join(ledger, rows_of):
    book = ledger([("A", "2020-01-05", 1), ("A", "2020-04-05", 2), ("B", "2020-02-05", 2), ("B", "2021-03-05", None or 3)])
    panel = P.monthly_panel(book, YearWindow(2019, 2022))
    bits = B.month_bits(book, F.col("price").isNotNull())
    kept = B.only_bought(panel, bits)
    anti = P.exclude_imputed(panel, P.missing_cells(book, YearWindow(2019, 2022)))
    assert rows_of(kept, *panel.columns) == rows_of(anti, *panel.columns)
    assert rows_of(kept, "rm_code", "month_idx") == [("A", month(2020, 1)), ("A", month(2020, 4)), ("B", month(2020, 2)), ("B", month(2021, 3))]


def test_empty_ledger(ledger):
    empty = ledger([("A", "2020-01-05", 1)]).limit(0)
    assert B.month_bits(empty).collect() == [] and P.missing_cells(empty).collect() == []


@pytest.mark.parametrize("name", ["missing_cells", "grid_left_facts"])
def test_gaps_need_no_join(spark, name):
    assert "Join" not in plan(QUERIES[name](spark, SMALL))


def test_excluding_months_joins_codes_only(spark):
    joins = re.findall(r"Join \[[^\]]*\], \[[^\]]*\]", plan(QUERIES["exclude_imputed"](spark, SMALL)))
    assert joins and all("month_idx" not in j for j in joins)


def test_the_report_on_bits_equals_the_report_on_cells(ledger):
    book = ledger([("A", "2020-01-05", 1), ("A", "2020-03-05", 2), ("B", "2020-02-05", 2)])
    panel = P.monthly_panel(book).withColumns({"average_price": F.col("price"), "AR_1": F.col("price")})
    stray = panel.withColumn("rm_code", F.lit("Z"))
    for rows in (panel, panel.where("not is_imputed"), panel.limit(0)):
        on_cells = Q.feature_report(rows, P.missing_cells(book), [], LagWindow(1, 1))
        on_bits = Q.feature_report(rows, B.month_bits(book, F.col("price").isNotNull()), [], LagWindow(1, 1))
        assert sorted(map(tuple, on_bits.collect())) == sorted(map(tuple, on_cells.collect()))
    unknown = Q.feature_report(stray, B.month_bits(book), [], LagWindow(1, 1))
    assert {r["check"]: r["violations"] for r in unknown.collect()}["imputed_target"] == stray.count()


def test_watched_frames_are_counted_by_the_writing_pass(spark, tmp_path):
    watch = Q.Watch()
    source = spark.createDataFrame([(1, None), (2, 5.0), (3, -1.0), (3, None)], "id int, price double")
    first = watch.frame(source, "source", Q.null_checks(["price"]) | {"low": F.col("price") < 0})
    kept = watch.frame(first.where("price IS NOT NULL"), "kept")
    kept.write.parquet(str(tmp_path / "kept"))
    assert watch.found("source") == [("is_empty", 0), ("null_price", 2), ("low", 1)]
    assert (watch.rows("source"), watch.rows("kept")) == (4, 2)
    report = Q.report_rows(spark, {"source": watch.found("source"), "kept": watch.found("kept")})
    assert {tuple(r) for r in report.collect()} == {
        ("source", "is_empty", 0), ("source", "null_price", 2), ("source", "low", 1), ("kept", "is_empty", 0),
    }
    empty = watch.frame(source.limit(0), "none", Q.null_checks(["price"]))
    empty.write.parquet(str(tmp_path / "none"))
    assert watch.found("none") == [("is_empty", 1), ("null_price", 0)]


def test_watching_adds_no_scan(spark):
    panel = P.monthly_panel(tables.clean_purchases(spark, SMALL))
    watched = Q.Watch().frame(panel, "panel", Q.null_checks(["price"]))
    scans = [plan(df).count("FileScan parquet") for df in (panel, watched)]
    assert scans[0] == scans[1] and "CollectMetrics" in plan(watched)
