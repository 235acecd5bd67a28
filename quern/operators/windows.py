"""Window calculations, ranks and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .aggs import quantiles
from .ordering import MOST, before_parts, in_parts


def demag_amplitudes(df: DataFrame, keys: Sequence[str] = ("act", "t", "h"), angle: str = "deg", keep: float | None = 180.0) -> DataFrame:
    """Differences to the previous orientation of the same experiment: change, pair mean, half amplitude and its percent, flux change, ratio of factors; rows at `keep` degrees (all if None)."""
    w = Window.partitionBy(*keys).orderBy(angle)
    before = lambda c: F.lag(c).over(w)
    out = df.withColumns({"delta_res": F.col("res") - before("res"), "mean_res": (F.col("res") + before("res")) / 2, "delta_b": F.col("b") - before("b"), "d_ratio": F.try_divide(F.col("d"), before("d"))})
    out = out.withColumn("amp_res", F.col("delta_res") / 2).withColumn("a_dem_pct", F.try_divide(F.col("amp_res"), F.col("mean_res")) * 100).withColumn("abs_a_dem_pct", F.abs("a_dem_pct"))
    return out if keep is None else out.where(F.col(angle) == keep)


def ratio_to_max(df: DataFrame, keys: Sequence[str], value: str, name: str = "amp_ratio") -> DataFrame:
    """Value over the largest of its group."""
    return df.withColumn(name, F.try_divide(F.col(value), F.max(value).over(Window.partitionBy(*keys))))


def top_n(df: DataFrame, keys: Sequence[str], value: str, n: int, tie: str) -> DataFrame:
    """The n rows of largest value per group, ties by the smaller `tie`; Spark keeps no more than n rows per group and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_second_ratio(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Second value over first, per group, in the order given."""
    w = Window.partitionBy(*keys).orderBy(order)
    two = df.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2")
    first, second = (F.max(F.when(F.col("__rn") == k, F.col(value))) for k in (1, 2))
    return two.groupBy(*keys).agg(F.try_divide(second, first).alias("ratio"))


def control_limits(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 5, k: float = 3.0, most: int = MOST) -> DataFrame:
    """Mean, limits mean +- k sd / sqrt(n) over the last n rows, and an alert where the value leaves them; rows with fewer than n before and at them drop out. `row` numbers a key's rows from 1.

    Keys of at most `most` rows are windows. Larger ones are numbered in parts and cut at every `most` rows, and the n - 1 rows before a cut are copied behind it, so that one key is many tasks.
    """

    def told(rows: DataFrame, part: Sequence[str]) -> DataFrame:
        frame = Window.partitionBy(*part).orderBy("row").rowsBetween(-(n - 1), 0)
        out = rows.withColumns({"center": F.avg(value).over(frame), "__half": k * F.stddev_samp(value).over(frame) / (float(n) ** 0.5)})
        out = out.withColumns({"upper": F.col("center") + F.col("__half"), "lower": F.col("center") - F.col("__half")})
        return out.withColumn("alert", (F.col(value) > F.col("upper")) | (F.col(value) < F.col("lower"))).where(F.col("row") >= n)

    most = max(most, n)
    rows, several = in_parts(df, keys, order, most)
    small = rows.where("__part = 0").withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    small = told(small, keys).drop("__half", "__part")
    if not several:
        return small
    at = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    large = before_parts(rows.where("__part > 0"), keys, {"__before": F.count(F.lit(1))})
    large = written(large.withColumn("row", (at + F.col("__before")).cast("long")).drop("__part", "__before"), "numbered")
    cut = F.floor((F.col("row") - 1) / most)
    behind = F.when((F.col("row") - 1) % most >= most - (n - 1), F.array(cut, cut + 1)).otherwise(F.array(cut))
    cuts = large.withColumn("__own", cut).withColumn("__cut", F.explode(behind))
    return small.unionByName(told(cuts, [*keys, "__cut"]).where("__own = __cut").drop("__half", "__own", "__cut"))


def score_category(df: DataFrame, value: str, k: int = 10, name: str = "category") -> DataFrame:
    """1 + the number of quantile cut points below the value; the cut points are found by counting passes, without a sort."""
    cuts = quantiles(df, [value], [i / k for i in range(1, k)])[value]
    below = F.size(F.filter(F.array(*(F.lit(c).cast("double") for c in cuts)), lambda c: c < F.col(value)))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), 1 + below))


def top_k(df: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    """The k rows of largest value overall, as a partial top-k per task and one merge."""
    return df.orderBy(F.desc(value), tie).limit(k)


def union_fill(a: DataFrame, b: DataFrame, fill: float = 0.0) -> DataFrame:
    """Rows of both tables; columns that one lacks, and missing numbers, are `fill`."""
    return a.unionByName(b, allowMissingColumns=True).na.fill(fill)
