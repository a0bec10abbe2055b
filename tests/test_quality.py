import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import panel as P
from ledgerloom.operators import quality as Q
from ledgerloom.config import LagWindow


def found(report):
    return {r["check"]: r["violations"] for r in report.collect() if r["violations"]}


GOOD = [("A", "2020-01-05", 1, "acid"), ("B", "2020-02-05", 2, "acid")]


def test_clean_ledger_passes(ledger):
    report = Q.ledger_report(ledger(GOOD), ["A", "B"], "acid")
    assert found(report) == {}
    Q.require(report)


def test_broken_ledger_is_reported(ledger):
    book = ledger([*GOOD, ("A", "2020-01-06", -1, "base"), ("C", "2020-01-06", 3, "base")])
    book = book.withColumn("price", F.when(F.col("rm_code") != "B", F.col("price")))
    report = Q.ledger_report(book, ["A", "C", "Z"], "acid")
    assert found(report) == {
        "null_price": 1,
        "price_not_positive": 1,
        "code_in_several_groups": 1,
        "code_not_found": 1,
        "code_outside_target": 2,
    }
    with pytest.raises(ValueError, match="code_not_found: 1"):
        Q.require(report)


def test_empty_ledger(ledger):
    assert found(Q.ledger_report(ledger(GOOD).limit(0))) == {"is_empty": 1}


def test_leading_null_of_a_driver(spark):
    series = spark.createDataFrame([("GAS", None), ("GAS", 1.0)], "driver string, value double")
    assert found(Q.driver_report(series)) == {"null_driver_value": 1}


def test_imputed_target_is_found(ledger):
    book = ledger([("A", "2020-01-05", 1), ("A", "2020-03-05", 2), ("B", "2020-02-05", 2)])
    panel = P.monthly_panel(book).withColumns({"average_price": F.col("price"), "AR_1": F.col("price")})
    missing = P.missing_cells(book)
    assert found(Q.feature_report(panel, missing, [], LagWindow(1, 1))) == {"imputed_target": 2}
    real = panel.where("not is_imputed")
    assert found(Q.feature_report(real, missing, [], LagWindow(1, 1))) == {}


def test_every_broken_check_is_named(spark):
    broken = spark.createDataFrame([(f"check_{k:02d}", k % 3) for k in range(40)], "check string, violations long")
    with pytest.raises(ValueError) as error:
        Q.require(broken)
    assert str(error.value).count("check_") == 26


def test_absent_drivers_are_counted(spark):
    series = spark.createDataFrame([("GAS", 1.0)], "driver string, value double")
    assert found(Q.driver_report(series, ["GAS", "OIL", "COAL"])) == {"driver_not_found": 2}
    assert found(Q.driver_report(series.limit(0), ["GAS"])) == {"is_empty": 1, "driver_not_found": 1}


def test_row_counts_of_steps(spark):
    three, five = spark.range(3), spark.range(5)
    assert found(Q.not_more_rows(three, five)) == {}
    assert found(Q.not_more_rows(five, three)) == {"rows_added": 2}
    assert found(Q.same_rows(three, five)) == {"rows_changed": 2}
    assert found(Q.same_rows(five, five)) == {}
