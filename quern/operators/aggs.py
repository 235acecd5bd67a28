"""Grouped summaries, rates and evaluation measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_var_by(df: DataFrame, key: str, value: str, digits: int = 1, names: tuple[str, str] = ("avg_price", "var_price")) -> DataFrame:
    """Mean and sample variance of a value per key, rounded half to even."""
    return df.groupBy(key).agg(F.bround(F.avg(value), digits).alias(names[0]), F.bround(F.var_samp(value), digits).alias(names[1]))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows (value, n, share of all rows)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.crossJoin(total).select(col, "n", (F.col("n") / F.col("total")).alias("share"))


def _bin(col: str, edges: Sequence[float]) -> Column:
    """Number of the bin [edge, next edge), the last closed; missing outside."""
    c, last = F.col(col), len(edges) - 2
    out = F.when((c >= edges[0]) & (c <= edges[-1]), F.least(F.lit(last), sum((F.when(c >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))))
    return out.cast("int")


def even_edges(df: DataFrame, col: str, bins: int) -> list[float]:
    """Edges of `bins` bins of one width between the least and the greatest finite value; around a single value, half a unit to both sides; none without values."""
    x = F.col(col).cast("double")
    lo, hi = df.agg(*(f(F.when(F.abs(x) < math.inf, x)) for f in (F.min, F.max))).first()
    if lo is None:
        return []
    lo, hi = (lo, hi) if lo < hi else (lo - 0.5, hi + 0.5)
    return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]


def histogram(df: DataFrame, col: str, edges: Sequence[float] | int) -> DataFrame:
    """Rows (bin, lo, hi, n) of the bins that have values. Edges are given, or their number of bins is, see even_edges."""
    edges = even_edges(df, col, edges) or [0.0, 0.0] if isinstance(edges, int) else edges
    at = F.array(*(F.lit(float(e)) for e in edges))
    counts = df.select(_bin(col, edges).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", at[F.col("bin")].alias("lo"), at[F.col("bin") + 1].alias("hi"), "n")


def histogram2d(df: DataFrame, x: str, y: str, x_edges: Sequence[float], y_edges: Sequence[float]) -> DataFrame:
    """Rows (x_bin, y_bin, n)."""
    binned = df.select(_bin(x, x_edges).alias("x_bin"), _bin(y, y_edges).alias("y_bin")).where("x_bin IS NOT NULL AND y_bin IS NOT NULL")
    return binned.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], bins: int = 1000) -> dict[str, list[float | None]]:
    """Exact quantiles of number columns, interpolated between neighbouring ranks; missing for a column without values. NaN and missing values are left out; infinite ones are the ends of the ranks
    (a quantile between two unlike infinities is NaN).

    The rank that a quantile needs is enclosed: each pass counts the finite values of the enclosing interval in `bins` equal parts and goes on with the part that holds the rank,
    between its least and largest value, until these are equal, most often after two to five passes. The ends of an interval fall into unlike parts, so every pass narrows it. A pass is a count with partial sums, so no task gets more than bins x quantiles rows.
    """
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    finite = {c: F.when(F.abs(x[c]) < math.inf, x[c]) for c in cols}
    first = df.agg(*(F.struct(F.count(x[c]).alias("n"), F.count_if(x[c] == -math.inf).alias("under"), F.count_if(x[c] == math.inf).alias("over"), F.min(finite[c]).alias("lo"), F.max(finite[c]).alias("hi")).alias(c) for c in cols)).first()
    held: dict[tuple[str, int], tuple[float, float, int]] = {}  # by column and rank: interval, and values below it
    for c in cols:
        s = first[c]
        for q in qs if s["n"] else ():
            at = q * (s["n"] - 1)
            for r in (math.floor(at), math.ceil(at)):
                end = -math.inf if r < s["under"] else math.inf if r >= s["n"] - s["over"] else None
                held[c, r] = (s["lo"], s["hi"], s["under"]) if end is None else (end, end, 0)
    while spans := sorted({(c, lo, hi) for (c, _), (lo, hi, _) in held.items() if lo < hi}):
        # halves where the width of the interval is no number
        half = [1.0 if math.isfinite(hi - lo) else 0.5 for _, lo, hi in spans]
        inside = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), finite[c].alias("x"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(h).alias("h")) for k, ((c, lo, hi), h) in enumerate(zip(spans, half, strict=True)))))
        some = df.select(inside.alias("s")).select("s.*").where("x BETWEEN lo AND hi")
        x_, lo_, hi_ = (F.col(c) * F.col("h") for c in ("x", "lo", "hi"))
        part = F.least(F.floor((x_ - lo_) / (hi_ - lo_) * bins), F.lit(bins - 1)).alias("part")
        told: dict[tuple[str, float, float], list] = {s: [] for s in spans}
        for r in some.groupBy("k", part).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("k", "part").collect():
            told[spans[r["k"]]].append((r["n"], r["a"], r["b"]))
        for (c, rank), (lo, hi, below) in held.items():
            for n, a, b in told.get((c, lo, hi), ()):
                if rank < below + n:
                    held[c, rank] = (a, b, below)
                    break
                below += n
    out: dict[str, list[float | None]] = {}
    for c in cols:
        at = [q * (first[c]["n"] - 1) for q in qs]
        out[c] = [held[c, math.floor(p)][0] if p == math.floor(p) else (math.ceil(p) - p) * held[c, math.floor(p)][0] + (p - math.floor(p)) * held[c, math.ceil(p)][0] for p in at] if first[c]["n"] else [None] * len(qs)
    return out


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A row per column: count, mean, sd, min, quartiles, max; quartiles by counting passes (see quantiles), the rest in one pass."""
    cuts, stats = quantiles(df, cols, (0.25, 0.5, 0.75)), []
    for c in cols:
        x = F.col(c).cast("double")
        quartiles = (F.lit(v).cast("double").alias(n) for n, v in zip(("q1", "median", "q3"), cuts[c], strict=True))
        stats.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), *quartiles, F.max(x).alias("max")).alias(f"s_{c}"))
    return df.agg(*stats).select(F.explode(F.array(*(F.col(f"s_{c}") for c in cols))).alias("s")).select("s.*")


def run_baselines(df: DataFrame, keys: Sequence[str], value: str, order: str, tie: str) -> DataFrame:
    """Per run, the mean and the value at the smallest angle (the smallest `tie` of several)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.min_by(value, F.struct(order, tie)).alias("first_value"))


def relative_deltas(df: DataFrame, keys: Sequence[str], value: str, order: str, tie: str) -> DataFrame:
    """Adds the change, its ratio and percent against the run's mean and against its value at the smallest angle, in one shuffle."""
    w = Window.partitionBy(*keys)
    mean, first = F.avg(value).over(w), F.min_by(value, F.struct(order, tie)).over(w)
    out = {}
    for name, base in (("mean", mean), ("first", first)):
        delta = F.col(value) - base
        out |= {f"delta_{name}": delta, f"delta_{name}_ratio": F.try_divide(delta, base), f"delta_{name}_pct": F.try_divide(delta, base) * 100}
    return df.withColumns(out)


def dominant_freq_summary(df: DataFrame, min_ratio: float, freq: str = "freq", ratio: str = "amp_ratio") -> DataFrame:
    """Count, sum and mean of the amplitude ratios of at least `min_ratio`, per frequency, largest sum first."""
    rows = df.where(F.col(ratio) >= min_ratio).groupBy(freq).agg(F.count(F.lit(1)).alias("n"), F.sum(ratio).alias("total"), F.avg(ratio).alias("mean"))
    return rows.orderBy(F.desc("total"), freq)


def satellite_average(scores: DataFrame, key: str, satellites: Sequence[str], sat: str = "sat_id", score: str = "score") -> DataFrame:
    """A column of scores per satellite and their mean, sat_avg."""
    per = [F.max(F.when(F.col(sat) == s, F.col(score))).alias(f"score_{s}") for s in satellites]
    return scores.groupBy(key).agg(*per, F.avg(score).alias("sat_avg"))


def percent_of_universe(df: DataFrame, universe: DataFrame, keys: Sequence[str], value: str = "value", total: str = "universe_total") -> DataFrame:
    """Each count as a percent of its universe's total; missing where that is zero or unknown."""
    return df.join(universe, list(keys), "left").withColumn("pct", F.try_divide(F.col(value), F.col(total)) * 100)


def rate_by(df: DataFrame, flag: Column, dims: Sequence[str]) -> DataFrame:
    """Rows and share of flagged rows per combination of dimensions."""
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(flag.cast("double"), F.lit(0.0))).alias("rate"))


def group_extent(df: DataFrame, keys: Sequence[str], value: str, listed: str) -> DataFrame:
    """The largest value and the sorted distinct values of another column, per group."""
    return df.groupBy(*keys).agg(F.max(value).alias("max_value"), F.sort_array(F.collect_set(listed)).alias("listed"))


def symmetrize(df: DataFrame, keys: Sequence[str], field: str, value: str) -> DataFrame:
    """Mean of the values at +H and -H, for groups that have both signs (or H = 0)."""
    plus = F.avg(F.when(F.col(field) >= 0, F.col(value)))
    minus = F.avg(F.when(F.col(field) <= 0, F.col(value)))
    return df.groupBy(*keys, F.abs(field).alias("abs_h")).agg(((plus + minus) / 2).alias("sym_value")).where("sym_value IS NOT NULL")


def fires_by_year(df: DataFrame, day: str = "acq_date", sat: str = "sat_id") -> DataFrame:
    """Fires per year and satellite after the filter of presumed vegetation fires of high confidence."""
    return df.where((F.col("type") == 0) & (F.col("confidence") == "h")).groupBy(F.year(day).alias("year"), sat).agg(F.count(F.lit(1)).alias("n"))


def rmse(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(yhat), 2))).alias("rmse"))


def precision_kpi(df: DataFrame, y: str, yhat: str, period: str | None = None, floor: float = 0.6) -> DataFrame:
    """TP / (TP + FP), per period if given, and whether it is below the floor; missing without a positive prediction."""
    found = F.try_divide(F.sum(F.when((F.col(yhat) == 1) & (F.col(y) == 1), 1.0).otherwise(0.0)), F.sum(F.when(F.col(yhat) == 1, 1.0).otherwise(0.0)))
    out = df.groupBy(period).agg(found.alias("precision")) if period else df.agg(found.alias("precision"))
    return out.withColumn("below_floor", F.col("precision") < floor)


def poisson_deviance(df: DataFrame, y: str, mu: str) -> DataFrame:
    """2 mean(y ln(y / mu) - y + mu); a term with y = 0 is 2 mu."""
    v, m = F.col(y), F.col(mu)
    return df.agg((2 * F.avg(F.when(v == 0, m).otherwise(v * F.ln(v / m) - v + m))).alias("poisson_deviance"))
