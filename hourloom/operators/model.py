"""Daily regression: time-ordered split, training, evaluation, scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import DATE, SERIES, TARGET, BoostingConfig, ForestConfig
from hourloom.operators.clean import drop_unusable
from hourloom.session import gathered


def _position(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row number by date and row count of each series (daily tables: bounded by the calendar)."""
    series = Window.partitionBy(*keys)
    return df.withColumns({"_i": F.row_number().over(series.orderBy(DATE)), "_n": F.count("*").over(series)})


def time_split(features: DataFrame, test_size: float = 0.2, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Adds `split`: the first int(n * (1 - test_size)) days of each series train, the rest test."""
    placed = _position(features, keys)
    cut = F.floor(F.col("_n") * F.lit(1 - test_size))
    return placed.withColumn("split", F.when(F.col("_i") <= cut, "train").otherwise("test")).drop("_i", "_n")


def fold_plan(train: DataFrame, folds: int = 5, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Adds `fold`: the expanding-window fold that tests the row; null before the first fold.

    Fold f tests n // (folds + 1) rows and trains on every row with a smaller fold (or none).
    """
    placed = _position(train, keys)
    size = F.floor(F.col("_n") / (folds + 1))
    from_end = F.col("_n") - F.col("_i")
    fold = folds - F.floor(from_end / size)
    valid = (size > 0) & (fold >= 1)
    return placed.withColumn("fold", F.when(valid, fold).cast("int")).drop("_i", "_n")


def fold_bounds(train: DataFrame, folds: int = 5, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Train and test sizes and first and last test date of every fold."""
    sizes = fold_plan(train, folds, keys).groupBy(*keys, "fold").agg(
        F.count("*").alias("test_rows"), F.min(DATE).alias("test_from"), F.max(DATE).alias("test_to")
    )
    earlier = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("fold")).rowsBetween(Window.unboundedPreceding, -1)
    train_rows = F.coalesce(F.sum("test_rows").over(earlier), F.lit(0))
    return sizes.withColumn("train_rows", train_rows).where(F.col("fold").isNotNull())


def _assembler(features: Sequence[str], scale: bool) -> list:
    inputs = VectorAssembler(inputCols=list(features), outputCol="_assembled" if scale else "_features")
    if not scale:
        return [inputs]
    return [inputs, StandardScaler(inputCol="_assembled", outputCol="_features", withMean=True, withStd=True)]


def standard_scaler(features: Sequence[str]) -> Pipeline:
    """Assembles and standardises feature columns."""
    return Pipeline(stages=_assembler(features, scale=True))


def forest(target: str = TARGET, config: ForestConfig = ForestConfig()) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="_features",
        labelCol=target,
        predictionCol="prediction",
        numTrees=config.trees,
        maxDepth=config.depth,
        minInstancesPerNode=config.min_leaf,
        maxBins=config.max_bins,
        maxMemoryInMB=config.memory_mb,
        featureSubsetStrategy="all",
        seed=config.seed,
    )


def boosting(target: str = TARGET, config: BoostingConfig = BoostingConfig()) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="_features",
        labelCol=target,
        predictionCol="prediction",
        maxIter=config.rounds,
        maxDepth=config.depth,
        stepSize=config.step,
        maxBins=config.max_bins,
        seed=config.seed,
    )


def train(rows: DataFrame, features: Sequence[str], regressor=None, scale: bool = False, partitions: int | None = None) -> PipelineModel:
    """Fit on rows that have the target and every feature; trees need no scaling.

    Bootstrap samples depend on the partitions, so a caller who wants the same trees from the same rows names their
    number; None keeps the table's own.
    """
    regressor = regressor if regressor is not None else forest()
    target = regressor.getLabelCol()
    usable = drop_unusable(rows, target, features).select(
        *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, target])]
    )
    return Pipeline(stages=[*_assembler(features, scale), regressor]).fit(gathered(usable, partitions))


def predict(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds `prediction` to the rows that have every feature."""
    keep = rows.columns
    return model.transform(rows.na.drop("any", subset=list(features))).select(*keep, "prediction")


def importance_table(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double")


def top_features(importances: DataFrame, n: int = 15) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def regression_metrics(
    scored: DataFrame,
    actual: str = TARGET,
    prediction: str = "prediction",
    keys: Sequence[str] = (SERIES,),
    more: Sequence[Column] = (),
) -> DataFrame:
    """MAE, RMSE, R2 and MAPE, and `more` aggregates. Days with a zero actual do not enter MAPE and are counted."""
    y, e = F.col(actual), F.col(actual) - F.col(prediction)
    rows = scored.where(y.isNotNull() & F.col(prediction).isNotNull())
    sse, sst = F.sum(e * e), F.var_pop(actual) * F.count("*")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(sse, sst)).alias("r2"),
        (F.avg(F.abs(F.when(y != 0, e / y))) * 100).alias("mape"),
        F.count_if(y == 0).alias("zero_actuals"),
        *more,
    )


def cross_validate(
    train_rows: DataFrame, features: Sequence[str], regressor=None, folds: int = 5, keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Expanding-window scores: MAE per fold with their mean and population deviation."""
    regressor = regressor if regressor is not None else forest()
    target = regressor.getLabelCol()
    plan = fold_plan(drop_unusable(train_rows, target, features), folds, keys).persist()
    scores = []
    try:
        for fold in range(1, folds + 1):
            earlier = plan.where(F.coalesce("fold", F.lit(0)) < fold)
            model = train(earlier, features, regressor)
            scored = predict(model, plan.where(F.col("fold") == fold), features)
            mae = scored.agg(F.avg(F.abs(F.col(target) - F.col("prediction")))).first()[0]
            scores.append((fold, mae))
    finally:
        plan.unpersist()
    known = [m for _, m in scores if m is not None]
    table = train_rows.sparkSession.createDataFrame(scores, "fold int, mae double")
    return table.withColumns(
        {"cv_mae": F.lit(float(np.mean(known))), "cv_mae_std": F.lit(float(np.std(known)))}
    )


def score_dates(
    model: PipelineModel, features_table: DataFrame, requests: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Prediction and the feature values used, for the requested (series_id, date) rows."""
    wanted = requests.join(features_table, [SERIES, DATE])
    used = F.struct(*[F.col(f) for f in features]).alias("features_used")
    return predict(model, wanted, features).select(*requests.columns, TARGET, "prediction", used)


def contributions(importances: Mapping[str, float], n: int = 5) -> Column:
    """The `n` features with the largest |value * importance|, as an ordered array."""
    weighted = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"), (F.col(name).cast("double") * F.lit(float(w))).alias("weight")
            )
            for name, w in importances.items()
        ]
    )

    def larger_first(a: Column, b: Column) -> Column:
        left, right = F.coalesce(F.abs(a["weight"]), F.lit(-1.0)), F.coalesce(F.abs(b["weight"]), F.lit(-1.0))
        return (
            F.when(left > right, -1)
            .when(left < right, 1)
            .when(a["feature"] < b["feature"], -1)
            .when(a["feature"] > b["feature"], 1)
            .otherwise(0)
        )

    return F.slice(F.array_sort(weighted, larger_first), 1, n)
