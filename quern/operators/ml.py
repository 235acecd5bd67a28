"""Feature pipelines, splits, and models of Spark ML with cross-validation."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import clean
from .neighbors import nearest_rows


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 77) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key: a row is on the same side however the table is partitioned."""
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000))
    return df.where(place >= int(test * 10_000)), df.where(place < int(test * 10_000))


def scale(df: DataFrame, cols: Sequence[str], how: str = "minmax") -> DataFrame:
    """Columns scaled to [0, 1], or to mean 0 and sample deviation 1; constant ones become 0. All statistics are one pass."""
    stats = [x for c in cols for x in ((F.min(c).alias(f"__a_{c}"), (F.max(c) - F.min(c)).alias(f"__b_{c}")) if how == "minmax" else (F.avg(c).alias(f"__a_{c}"), F.stddev_samp(c).alias(f"__b_{c}")))]
    one = F.broadcast(df.agg(*stats))  # one row
    scaled = {c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"__a_{c}"), F.col(f"__b_{c}")), F.lit(0.0))) for c in cols}
    return df.crossJoin(one).withColumns(scaled).drop(*(f"__{k}_{c}" for k in "ab" for c in cols))


def house_features(df: DataFrame, cities: Sequence[str]) -> DataFrame:
    """Cleaned houses as features: cities one-hot by a fixed list, type by order, year and month of sale, logarithm of the area."""
    out = sc.ordinal_encode(sc.one_hot(df, "city", cities), "house_type", clean.HOUSE_TYPES)
    out = sc.log_col(sc.date_parts(out, "sale_date").drop("day"), "area", "log_area")
    return out.drop("sale_date", "area")


def recipe_features(df: DataFrame) -> DataFrame:
    """Cleaned recipes as features: label 1 for high traffic, categories one-hot."""
    out = sc.label_if(df, "label", F.col("high_traffic") == "High", 1, 0).drop("high_traffic")
    return sc.one_hot(out, "category", clean.RECIPE_CATEGORIES)


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    """Adds the features as a vector. A missing feature fails the job: rows are not left out in silence; fill or drop them before."""
    return VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="error").transform(df)


def _search(estimator, grid: list, evaluator, df: DataFrame, folds: int, seed: int) -> CrossValidatorModel:
    kept = df.cache()
    try:
        return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, seed=seed, parallelism=4).fit(kept)
    finally:
        kept.unpersist()


def _precision(label: str) -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="precisionByLabel", metricLabel=1.0)


def fit_logistic(df: DataFrame, features: str = "features", label: str = "label", c_values: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0), penalties: Sequence[float] = (0.0, 0.5, 1.0), free: bool = True, folds: int = 5, seed: int = 77) -> CrossValidatorModel:
    """Logistic regression by precision over penalty (0: L2, 1: L1, between: both) and C, and with `free` no penalty; regParam = 1 / (C n), features not standardized."""
    n = df.count()
    model = LogisticRegression(featuresCol=features, labelCol=label, standardization=False, maxIter=100)
    grid = ParamGridBuilder().addGrid(model.regParam, [1 / (c * n) for c in c_values]).addGrid(model.elasticNetParam, list(penalties)).build()
    grid += [{model.regParam: 0.0, model.elasticNetParam: 0.0}] if free else []
    return _search(model, grid, _precision(label), df, folds, seed)


def fit_linear_svc(df: DataFrame, features: str = "features", label: str = "label", c_values: Sequence[float] = (0.01, 0.1, 1.0), folds: int = 5, seed: int = 77) -> CrossValidatorModel:
    """Linear support vectors with the hinge loss by precision over C. For the squared hinge see svm.fit_squared_hinge."""
    n = df.count()
    model = LinearSVC(featuresCol=features, labelCol=label, standardization=False, maxIter=50)
    grid = ParamGridBuilder().addGrid(model.regParam, [1 / (c * n) for c in c_values]).build()
    return _search(model, grid, _precision(label), df, folds, seed)


def _weight(weights: Column) -> Column:
    return F.when(weights == "uniform", F.lit(1.0)).when(F.col("__d") == 0, 1e12).otherwise(1 / F.col("__d"))


def knn_classify(train: DataFrame, query: DataFrame, k: int, key: str, label: str, vector: str = "v", metric: str = "euclidean", weights: str = "uniform", others: bool = False) -> DataFrame:
    """Votes of the k nearest training rows for each query row: rows (key, vote), of the exact neighbours that nearest_rows finds. Ties by the smaller label. With `others` a row does not vote on itself."""
    best = nearest_rows(train, query, k, key, vector, metric, [label], key if others else None)
    votes = best.groupBy("__q", label).agg(F.sum(_weight(F.lit(weights))).alias("w"))
    win = votes.groupBy("__q").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(label).alias("vote"))).alias("x"))
    return win.select(F.col("__q").alias(key), "x.vote")


def knn_grid(train: DataFrame, query: DataFrame, key: str, label: str, fold: str, vector: str = "v", ks: Sequence[int] = (3, 5, 7), weights: Sequence[str] = ("uniform", "distance"), metrics: Sequence[str] = ("euclidean", "manhattan"), positive: int | str | None = None) -> DataFrame:
    """Cross-validated search over neighbours, weights and metric: rows (metric, weights, k, accuracy), over the stated query rows, each of which is voted on by the
    training rows of the other folds (column `fold` of both tables). With `positive` also precision: the share of rows voted so whose label it is; missing where none are."""
    out, own = None, query.select(F.col(key).alias("__q"), F.col(label).alias("__ql"))
    right, said = F.col("x.vote") == F.col("__ql"), F.col("x.vote") == F.lit(positive)
    measures = [F.avg(right.cast("double")).alias("accuracy"), *([F.avg(F.when(said, right.cast("double"))).alias("precision")] if positive is not None else [])]
    for metric in metrics:
        best = nearest_rows(train, query, max(ks), key, vector, metric, [label], fold).join(own, "__q")
        tries = best.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where("__rn <= k").withColumn("weights", F.explode(F.array(*(F.lit(w) for w in weights))))
        votes = tries.groupBy("weights", "k", "__q", "__ql", label).agg(F.round(F.sum(_weight(F.col("weights"))), 9).alias("w"))
        win = votes.groupBy("weights", "k", "__q", "__ql").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(label).alias("vote"))).alias("x"))
        told = win.groupBy("weights", "k").agg(*measures).select(F.lit(metric).alias("metric"), "weights", "k", "accuracy", *(["precision"] if positive is not None else []))
        out = told if out is None else out.unionByName(told)
    return out


def fit_random_forest(df: DataFrame, features: str = "features", label: str = "label", trees: Sequence[int] = (20, 50), depths: Sequence[int] = (5, 10), folds: int = 5, seed: int = 77) -> CrossValidatorModel:
    """Random-forest regression by RMSE over trees and depth."""
    model = RandomForestRegressor(featuresCol=features, labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(model.numTrees, list(trees)).addGrid(model.maxDepth, list(depths)).build()
    return _search(model, grid, RegressionEvaluator(labelCol=label, metricName="rmse"), df, folds, seed)


def fit_gbt(df: DataFrame, features: str = "features", label: str = "label", trees: int = 500, rate: float = 0.01, depth: int = 5, subsample: float = 0.8, draws: int = 0, folds: int = 3, seed: int = 77):
    """Boosted trees with fixed settings, or the best of `draws` random ones by RMSE. Least gain and rows per leaf stand for the settings of other libraries that have the same end."""
    model = GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, seed=seed)
    if not draws:
        return model.fit(df)
    rng = random.Random(seed)
    grid = [{model.maxDepth: rng.randint(2, 8), model.stepSize: 10 ** rng.uniform(-2, -0.5), model.maxIter: rng.choice([20, 50, 100]), model.subsamplingRate: rng.uniform(0.5, 1), model.minInstancesPerNode: rng.randint(1, 10), model.minInfoGain: rng.choice([0.0, 0.001, 0.01])} for _ in range(draws)]
    return _search(model, grid, RegressionEvaluator(labelCol=label, metricName="rmse"), df, folds, seed)


def feature_weights(model, names: Sequence[str], spark) -> DataFrame:
    """Rows (feature, weight): absolute coefficients, or importances of a tree model."""
    if isinstance(model, CrossValidatorModel):
        model = model.bestModel
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    values = model.featureImportances if hasattr(model, "featureImportances") else [abs(x) for x in getattr(model.coefficients, "toArray", lambda: model.coefficients)()]
    return spark.createDataFrame([(n, float(values[i])) for i, n in enumerate(names)], "feature string, weight double")
