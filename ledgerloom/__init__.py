"""Price-panel analytics on Spark.

Every operator takes and returns DataFrames, so runs are composed with
``df.transform(...)`` and stay lazy until the caller writes or collects.
"""

from ledgerloom.config import ForecastWindow, JobRequest, LagWindow, YearWindow, half_years
from ledgerloom.operators.baseline import (
    naive_backtest,
    naive_errors,
    naive_shift_forecast,
    persistence_mape,
)
from ledgerloom.operators.clean import clean_ledger
from ledgerloom.operators.features import ar_lags, driver_lags, feature_matrix, interaction_terms
from ledgerloom.operators.lasso import backtest, train_all_features, train_ar
from ledgerloom.operators.panel import exclude_imputed, impute_ffill, monthly_panel, monthly_target
from ledgerloom.operators.charts import actual_vs_predicted
from ledgerloom.sources.drivers import read_driver_series, read_electricity
from ledgerloom.sources.json_records import parse_json_records, to_json_records
from ledgerloom.sources.ledger import read_ledger

__all__ = [
    "ForecastWindow",
    "JobRequest",
    "LagWindow",
    "YearWindow",
    "actual_vs_predicted",
    "ar_lags",
    "backtest",
    "clean_ledger",
    "driver_lags",
    "exclude_imputed",
    "feature_matrix",
    "half_years",
    "impute_ffill",
    "interaction_terms",
    "monthly_panel",
    "monthly_target",
    "naive_backtest",
    "naive_errors",
    "naive_shift_forecast",
    "parse_json_records",
    "persistence_mape",
    "read_driver_series",
    "read_electricity",
    "read_ledger",
    "to_json_records",
    "train_all_features",
    "train_ar",
]
