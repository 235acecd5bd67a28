"""Positions of rows in their key's order, also where one key holds much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a key that are numbered in one task.
MOST = 1_000_000
#: Keys above that number are sent to all tasks only while they are this few.
FEW = 100_000


def _same(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]


def _named(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = MOST) -> tuple[DataFrame, bool]:
    """df with `__part`, and whether any key has several parts. Parts of a key ascend with its order.

    Keys of at most `most` rows are one part, 0. Rows of larger keys are dealt by ranges of (keys, order) and written once, since ranges are sampled; rows equal in all of
    these columns stay together. Keys are counted when this is called. A missing key is a key like others.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    large = written(df.select(*_named(keys)).groupBy(*own).count().where(F.col("count") > most).select(*own), "large-keys")
    found = large.count()
    if not found:
        return df.withColumn("__part", F.lit(0)), False
    large = F.broadcast(large) if found <= FEW else large
    hot = df.join(large, _same(keys), "left_semi").repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id() + 1)
    return df.join(large, _same(keys), "left_anti").withColumn("__part", F.lit(0)).unionByName(written(hot, "key-parts")), True


def before_parts(rows: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """rows, which in_parts made, with the totals of `sums` over the parts before a row's (0 in the first). One row for each key and part is summed up in order: as many as there are parts, and keys of several."""
    own, w = [f"__k{i}" for i in range(len(keys))], Window.partitionBy(*(f"__k{i}" for i in range(len(keys)))).orderBy("__p")
    told = rows.where("__part > 0").groupBy(*_named(keys), F.col("__part").alias("__p")).agg(*(c.alias(n) for n, c in sums.items()))
    told = told.select(*own, "__p", *((F.sum(n).over(w) - F.col(n)).alias(n) for n in sums))
    joined = rows.join(told, [*_same(keys), F.col("__part") == F.col("__p")], "left").drop(*own, "__p")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in sums})


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row", most: int = MOST) -> DataFrame:
    """Adds the position of each row in its key's order, from 0. Keys of more than `most` rows are numbered in parts, each from the count of the parts before. Of rows equal in `order` any may come first."""
    rows, several = in_parts(df, keys, order, most)
    at = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1
    if not several:
        return rows.withColumn(name, at.cast("long")).drop("__part")
    rows = before_parts(rows, keys, {"__before": F.count(F.lit(1))})
    return rows.withColumn(name, (at + F.col("__before")).cast("long")).drop("__part", "__before")
