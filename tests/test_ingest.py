from datetime import datetime

from ledgerloom.config import YearWindow
from ledgerloom.operators.clean import clean_ledger
from ledgerloom.operators.panel import monthly_panel
from ledgerloom.streaming import ingest as I

SCHEMA = "rm_code string, group_desc string, ts timestamp_ntz, price double"
YEARS = YearWindow(2010, 2024)
FILES = [
    [("A", "acid", datetime(2020, 1, 5), 1.0), ("A", "acid", datetime(2020, 3, 5), 3.0)],
    [("A", "acid", datetime(2020, 1, 20), 2.0), ("B", "acid", datetime(2020, 2, 1), 9.0)],
    [("A", "acid", datetime(2020, 1, 20), 8.0), ("A", "acid", datetime(2020, 2, 28), 5.0)],
]


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, root, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    I.ingest(clean_ledger(stream, YEARS), root, **how).awaitTermination()


def test_files_arriving_one_by_one_equal_one_batch(spark, tmp_path, rows_of):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in FILES:
        land(spark, folder, rows)
        run(spark, folder, root)
    batch = monthly_panel(clean_ledger(spark.read.schema(SCHEMA).parquet(folder), YEARS))
    panel = I.stored_panel(spark, root)
    assert rows_of(panel) == rows_of(batch.select(panel.columns))
    january = panel.where("rm_code = 'A' and month_idx = 24240").first()
    assert january["n_purchases"] == 3 and january["price"] == 11 / 3


def test_nothing_new_changes_nothing(spark, tmp_path, rows_of):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, folder, FILES[0])
    run(spark, folder, root)
    before = rows_of(I.stored_panel(spark, root))
    run(spark, folder, root)
    assert rows_of(I.stored_panel(spark, root)) == before


def test_repeated_batch_overwrites_itself(spark, tmp_path, rows_of):
    store = str(tmp_path / "out")
    batch = clean_ledger(spark.createDataFrame(FILES[0], SCHEMA), YEARS)
    I._announce(spark, store, -1, "ignore")
    I._store_batch(batch, 0, store)
    once = rows_of(I.stored_months(spark, store))
    I._store_batch(batch, 0, store)
    assert rows_of(I.stored_months(spark, store)) == once


def test_folding_changes_nothing_and_can_be_repeated(spark, tmp_path, rows_of):
    folder, plain, folded = (str(tmp_path / n) for n in ("in", "plain", "folded"))
    for rows in FILES:
        land(spark, folder, rows)
    run(spark, folder, plain, fold_every=100)
    run(spark, folder, folded, fold_every=2)
    assert I._base(spark, plain) == -1 and I._base(spark, folded) == 1
    expected = rows_of(I.stored_panel(spark, plain))
    assert rows_of(I.stored_panel(spark, folded)) == expected
    I.fold(spark, folded, 1)  # announced already
    I.stored_months(spark, folded).limit(0).drop("avg_price").write.parquet(f"{folded}/bases/2")  # cut off
    assert rows_of(I.stored_panel(spark, folded)) == expected
    I.fold(spark, folded, 2)
    assert I._base(spark, folded) == 2 and rows_of(I.stored_panel(spark, folded)) == expected
