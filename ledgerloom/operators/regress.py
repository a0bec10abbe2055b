"""Tuned non-linear regressor on a feature matrix, with its scaler saved along."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F


def fold_of(keys: list[str], folds: int, seed: int):
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % folds).cast("int")


def tune(
    train: DataFrame,
    columns: list[str],
    keys: list[str],
    depths: list[int],
    rounds: list[int],
    folds: int = 5,
    seed: int = 1,
    parallelism: int = 4,
    label: str = "average_price",
) -> CrossValidatorModel:
    """Grid search over tree depth and boosting rounds.

    The pipeline's scaler is Spark ML's: its quartiles are approximate and a column
    that does not vary becomes 0 (``scaling.robust_scale`` is exact and divides by 1).
    Folds are a digest of the row key, so they do not depend on partitioning.
    """
    gbt = GBTRegressor(labelCol=label, featuresCol="scaled", seed=seed)
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="raw"),
            RobustScaler(inputCol="raw", outputCol="scaled", withCentering=True),
            gbt,
        ]
    )
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, depths).addGrid(gbt.maxIter, rounds).build()
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(labelCol=label, metricName="r2"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    return search.fit(train.withColumn("fold", fold_of(keys, folds, seed)))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Predictions next to all input columns; keys travel along, no join by position."""
    return model.transform(features).drop("raw", "scaled")
