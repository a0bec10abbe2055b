import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import month
from ledgerloom.config import YearWindow
from ledgerloom.functions.months import first_day, month_of, year_of
from ledgerloom.operators import panel as P
from ledgerloom.operators.clean import clean_ledger

# A skips February; B buys in all three months.
GAP_MIDDLE = [
    ("A", "2020-01-10", 10),
    ("A", "2020-01-20", 20),
    ("A", "2020-03-05", 30),
    ("B", "2020-01-01", 1),
    ("B", "2020-02-01", 2),
    ("B", "2020-03-31", 3),
]


def test_gap_takes_last_purchase_price_not_the_mean(ledger, rows_of):
    panel = P.monthly_panel(ledger(GAP_MIDDLE))
    assert rows_of(panel.where("rm_code = 'A'"), "month_idx", "price", "is_imputed", "n_purchases") == [
        (month(2020, 1), 15.0, False, 2),
        (month(2020, 2), 20.0, True, 0),
        (month(2020, 3), 30.0, False, 1),
    ]


def test_filled_month_is_dated_on_the_15th(ledger, rows_of):
    panel = P.monthly_panel(ledger(GAP_MIDDLE)).where("is_imputed")
    assert rows_of(panel, "rm_code", "group_desc", "ts") == [("A", "acid", datetime(2020, 2, 15))]


def test_leading_gap_is_missing_but_never_filled(ledger, rows_of):
    rows = [("A", "2020-03-01", 5), *[r for r in GAP_MIDDLE if r[0] == "B"]]
    book = ledger(rows)
    assert rows_of(P.monthly_panel(book).where("rm_code = 'A'"), "month_idx") == [(month(2020, 3),)]
    assert rows_of(P.missing_cells(book)) == [
        ("A", month(2020, 1), True),
        ("A", month(2020, 2), True),
    ]


def test_full_panel_has_no_gaps(ledger, rows_of):
    book = ledger([r for r in GAP_MIDDLE if r[0] == "B"])
    assert P.missing_cells(book).count() == 0
    assert rows_of(P.monthly_panel(book), "is_imputed") == [(False,)] * 3
    assert P.impute_ffill(book).count() == book.count()


def test_ties_in_time_take_the_higher_price(ledger, rows_of):
    rows = [("A", "2020-01-10", 10), ("A", "2020-01-10", 12), ("A", "2020-01-10", 11)]
    rows += [("B", "2020-02-01", 1)]
    panel = P.monthly_panel(ledger(rows)).where("rm_code = 'A'")
    assert rows_of(panel, "month_idx", "price") == [(month(2020, 1), 11.0), (month(2020, 2), 12.0)]


def test_observed_calendar_is_years_times_months(ledger, rows_of):
    """December is seen in 2019 only, yet 2020 has one as well: years x months."""
    book = ledger([("A", "2019-12-31", 1), ("A", "2020-01-31", 2)])
    assert rows_of(P.month_grid(book), "month_idx") == [
        (month(2019, 1),),
        (month(2019, 12),),
        (month(2020, 1),),
        (month(2020, 12),),
    ]
    assert rows_of(P.monthly_panel(book), "month_idx", "is_imputed") == [
        (month(2019, 12), False),
        (month(2020, 1), False),
        (month(2020, 12), True),
    ]
    assert P.month_grid(book, "span").count() == 2
    assert P.month_grid(book, YearWindow(2019, 2020)).count() == 24


def test_unknown_calendar(ledger):
    with pytest.raises(ValueError):
        P.month_grid(ledger(GAP_MIDDLE), "lunar")


def test_calendar_comes_from_the_whole_ledger(ledger, rows_of):
    panel = P.monthly_panel(ledger(GAP_MIDDLE), codes=["A"])
    assert rows_of(panel, "rm_code", "month_idx")[1] == ("A", month(2020, 2))


def test_grid_left_facts_keeps_every_purchase(ledger):
    book = ledger(GAP_MIDDLE)
    joined = P.month_grid(book).join(book.select("rm_code", "month_idx", "ts", "price"), P.KEYS, "left")
    built = P.grid_left_facts(book)
    assert built.exceptAll(joined.select(built.columns)).count() == 0
    assert built.count() == joined.count() == 7


def test_panel_size_is_grid_less_leading_gaps(ledger):
    book = ledger(GAP_MIDDLE + [("C", "2020-02-02", 9)])
    leading = P.missing_cells(book).where("is_leading").count()
    assert P.monthly_panel(book).count() == P.month_grid(book).count() - leading


def test_monthly_last_keeps_last_known_values(spark, ledger, rows_of):
    book = ledger([("A", "2020-01-10", 10), ("A", "2020-01-20", 7)])
    assert rows_of(P.monthly_last(book, ["price"])) == [("A", month(2020, 1), datetime(2020, 1, 20), 7.0)]
    patchy = spark.createDataFrame(
        [("A", 1, datetime(2020, 1, 1), 5.0), ("A", 1, datetime(2020, 1, 9), None)],
        "rm_code string, month_idx int, ts timestamp_ntz, price double",
    )
    assert rows_of(P.monthly_last(patchy, ["price"])) == [("A", 1, datetime(2020, 1, 9), 5.0)]


def test_exclude_imputed(ledger, rows_of):
    book = ledger(GAP_MIDDLE)
    target = P.monthly_target(P.monthly_panel(book))
    kept = P.exclude_imputed(target, P.missing_cells(book))
    assert rows_of(kept, "rm_code", "month") == [("A", 1), ("A", 3), ("B", 1), ("B", 2), ("B", 3)]
    assert kept.where("is_imputed").count() == 0


def test_result_does_not_depend_on_partitioning(ledger, rows_of):
    book = ledger(GAP_MIDDLE * 3)
    one = P.monthly_panel(book.repartition(1))
    many = P.monthly_panel(book.repartition(16))
    assert rows_of(one) == rows_of(many)


def test_month_keys(spark, rows_of):
    months = spark.createDataFrame([(month(2019, 12),), (month(2020, 1),)], "m int")
    assert rows_of(months.select(year_of("m"), month_of("m"), first_day("m").cast("string"))) == [
        (2019, 12, "2019-12-01"),
        (2020, 1, "2020-01-01"),
    ]


def test_purchases_after_the_calendar_leave_no_rows(ledger, rows_of):
    book = ledger([("A", "2019-11-05", 1), ("A", "2020-03-05", 2)])
    panel = P.monthly_panel(book, YearWindow(2019, 2019))
    assert rows_of(panel, "month_idx", "price", "is_imputed") == [
        (month(2019, 11), 1.0, False),
        (month(2019, 12), 1.0, True),
    ]


def filled_by_hand(rows):
    """The panel one cell at a time, from rows of ``(code, timestamp, price)``."""
    years = {t.year for _, t, _ in rows}
    numbers = {t.month for _, t, _ in rows}
    out = []
    for code in {c for c, _, _ in rows}:
        carried = None
        for at in sorted(y * 12 + m - 1 for y in years for m in numbers):
            here = sorted((t, p) for c, t, p in rows if c == code and month(t.year, t.month) == at)
            if here:
                carried = here[-1][1]
                out.append((code, at, sum(p for _, p in here) / len(here), False))
            elif carried is not None:
                out.append((code, at, carried, True))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_panel_equals_brute_force_with_a_hot_code(spark, seed):
    """One code holds a third of all rows; others are sparse."""
    rng = random.Random(seed)
    rows = []
    for k in range(600):
        code = "hot" if k % 3 == 0 else f"c{rng.randrange(40)}"
        ts = datetime(rng.choice([2018, 2019, 2021]), rng.choice([1, 2, 3, 5, 8, 12]), rng.randrange(1, 29))
        rows.append((code, ts, float(rng.randrange(1, 100))))
    frame = spark.createDataFrame(rows, "rm_code string, ts timestamp_ntz, price double").repartition(9)
    panel = P.monthly_panel(clean_ledger(frame, YearWindow(2010, 2024)))
    got = sorted(tuple(r) for r in panel.select("rm_code", "month_idx", "price", "is_imputed").collect())
    assert got == filled_by_hand(rows)  # whole-number prices: sums are exact


def test_null_prices_keep_their_place_in_the_grid(spark, ledger, rows_of):
    book = ledger([("A", "2020-01-05", 1), ("A", "2020-02-05", 1), ("B", "2020-01-05", 1), ("C", "2020-02-01", 1)])
    blank = F.when((F.col("rm_code") == "A") & (F.col("month") == 1), F.col("price"))
    book = book.withColumn("price", blank)
    grid = P.month_grid(book)
    expected = grid.join(book, ["rm_code", "month_idx"], "left").select("rm_code", "month_idx", "ts", "price")
    assert rows_of(P.grid_left_facts(book)) == rows_of(expected)
    first = month(2020, 1)
    assert rows_of(P.missing_cells(book)) == [
        ("A", first + 1, False), ("B", first, True), ("B", first + 1, True), ("C", first, True), ("C", first + 1, True)
    ]
