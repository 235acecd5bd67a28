"""Joins to parameters, baselines, features and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_params(df: DataFrame, params: DataFrame, on: str = "t") -> DataFrame:
    """Measurements with the fitted parameters of their group; groups without a fit drop out."""
    return df.join(params, on, "inner")


def delta_vs_baseline(df: DataFrame, keys: Sequence[str], baseline: Column, value: str) -> DataFrame:
    """Adds the group's value where `baseline` holds (its mean if several) as <value>_0, and the change, its ratio and percent. Groups without a baseline keep missing ones."""
    base = df.where(baseline).groupBy(*keys).agg(F.avg(value).alias(f"{value}_0"))
    delta = F.col(value) - F.col(f"{value}_0")
    ratio = F.try_divide(delta, F.col(f"{value}_0"))
    return df.join(base, list(keys), "left").withColumns({f"delta_{value}": delta, f"delta_{value}_ratio": ratio, f"delta_{value}_pct": ratio * 100})


def join_features(props: DataFrame, fine: DataFrame, coarse: DataFrame, fine_key: str, coarse_key: str, features: Sequence[str]) -> DataFrame:
    """Features of the finest level that has them: those of `fine`, else those of `coarse`."""
    a = fine.select(fine_key, *(F.col(f).alias(f"__f_{f}") for f in features))
    b = coarse.select(coarse_key, *(F.col(f).alias(f"__c_{f}") for f in features))
    out = props.join(a, fine_key, "left").join(b, coarse_key, "left")
    return out.withColumns({f: F.coalesce(f"__f_{f}", f"__c_{f}") for f in features}).drop(*(f"__{k}_{f}" for k in "fc" for f in features))


def with_lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Left join of a dimension; the size of the dimension decides whether Spark broadcasts it."""
    right = dim.withColumnRenamed(dim_key, key) if dim_key and dim_key != key else dim
    return df.join(right, key, "left")


def universe_of(meta: DataFrame, names: DataFrame) -> DataFrame:
    """The universe of each named table; a name that the metadata do not have fails the query."""
    known = names.select("table").distinct().join(meta.select("table", "universe"), "table", "left")
    message = F.concat(F.lit("unknown table: "), F.col("table"))
    return known.withColumn("universe", F.when(F.col("universe").isNull(), F.raise_error(message)).otherwise(F.col("universe")))


def predictions(df: DataFrame, id_col: str, predicted: str = "prediction", truncate: bool = True) -> DataFrame:
    """Rows (id, price): predicted values as whole numbers, cut off or rounded half to even."""
    value = F.col(predicted).cast("long") if truncate else F.bround(predicted, 0).cast("long")
    return df.select(id_col, value.alias("price"))
