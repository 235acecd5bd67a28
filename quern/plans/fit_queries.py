"""Queries on grouped transforms and fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import fits
from ..operators.ordering import numbered
from .registry import query
from .tables import cte, table

_RUNS = cte("runs")
_ORDERED = f"{_RUNS}, o AS (SELECT run, v, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1 AS j, count(*) OVER (PARTITION BY run) AS n FROM runs)"


def _dft(freqs: str) -> str:
    return f"{_ORDERED}, s AS (SELECT run, k AS freq, sum(v * cos(2 * pi() * j * k / n)) / sqrt(count(*)) AS re, -sum(v * sin(2 * pi() * j * k / n)) / sqrt(count(*)) AS im FROM o, (SELECT unnest({freqs}) AS k) GROUP BY run, k)"


def _runs(spark, d):
    return table(spark, d, "runs").select("run", "ts", "event_id", "v")


def _angles(spark, d):
    """Runs with an even angle in [0, 2 pi): theta = 2 pi j / n."""
    rows = numbered(_runs(spark, d), ["run"], ["ts", "event_id"], "j")
    return rows.join(rows.groupBy("run").agg(F.count(F.lit(1)).alias("__n")), "run").withColumn("theta", 2 * math.pi * F.col("j") / F.col("__n"))


_PHASE = "CASE WHEN atan2(im, re) < 0 THEN atan2(im, re) + 2 * pi() ELSE atan2(im, re) END"


@query(f"""WITH {_ORDERED}, k AS (SELECT run, unnest(range(0, n // 2 + 1)) AS freq FROM (SELECT DISTINCT run, n FROM o)),
    s AS (SELECT run, freq, sum(v * cos(2 * pi() * j * freq / n)) / sqrt(count(*)) AS re, -sum(v * sin(2 * pi() * j * freq / n)) / sqrt(count(*)) AS im FROM o JOIN k USING (run) GROUP BY run, freq),
    m AS (SELECT *, sqrt(re * re + im * im) AS mag FROM s), t AS (SELECT *, max(mag) OVER (PARTITION BY run) AS top FROM m)
    SELECT run, cast(freq AS int) AS freq, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(mag, 6) AS mag, round({_PHASE}, 5) + 0.0 AS phase, round(mag / top, 6) AS amp_ratio FROM t WHERE freq < 10 QUALIFY row_number() OVER (PARTITION BY run ORDER BY mag DESC) <= 4""")
def fourier_by_group(spark, d):
    out = fits.fourier_by_group(_runs(spark, d), ["run"], ["ts", "event_id"], "v", max_freq=10, n=4)
    return out.select("run", "freq", *((F.round(c, 5 if c == "phase" else 6) + 0.0).alias(c) for c in ("re", "im", "mag", "phase", "amp_ratio")))


@query(f"WITH {_dft('[1, 2, 5]')} SELECT run, cast(freq AS int) AS freq, round(re, 7) AS re, round(im, 7) AS im, round(sqrt(re * re + im * im), 7) AS mag, round(CASE WHEN atan2(im, re) < 0 THEN atan2(im, re) + 2 * pi() ELSE atan2(im, re) END, 7) AS phase FROM s")
def dft_at(spark, d):
    out = fits.dft_at(_runs(spark, d), ["run"], ["ts", "event_id"], "v", [1, 2, 5])
    return out.select("run", "freq", *(F.round(c, 7).alias(c) for c in ("re", "im", "mag", "phase")))


@query(f"""WITH {_ORDERED}, s AS (SELECT run, count(*) AS n, sum(v * v) AS vv, avg(v) AS m, 2 * avg(v * sin(2 * 2 * pi() * j / n)) AS a2, 2 * avg(v * cos(2 * 2 * pi() * j / n)) AS b2, 2 * avg(v * sin(4 * 2 * pi() * j / n)) AS a4, 2 * avg(v * cos(4 * 2 * pi() * j / n)) AS b4 FROM o GROUP BY run),
    c AS (SELECT *, a2 * a2 + b2 * b2 AS r2, a4 * a4 + b4 * b4 AS r4, (vv - n * m * m - n / 2 * (a2 * a2 + b2 * b2 + a4 * a4 + b4 * b4)) / (n - 5) AS chi2 FROM s)
    SELECT run, n, round(m, 6) AS mean, round(sqrt(chi2 / n), 6) AS mean_err, round(chi2, 4) AS red_chi2, {', '.join(f'''round(sqrt(r{f}) / m, 6) AS amp_{f}, round(sqrt(chi2 / n * (r{f} / m ** 4 + 2 / m ** 2)), 6) AS amp_{f}_err, round(CASE WHEN atan2(b{f}, a{f}) < 0 THEN atan2(b{f}, a{f}) + 2 * pi() ELSE atan2(b{f}, a{f}) END, 5) AS phase_{f}, round(sqrt(2 * chi2 / n / r{f}), 5) AS phase_{f}_err''' for f in (2, 4))} FROM c""")
def harmonic_fit(spark, d):
    """On even angles the sines and cosines are orthogonal, so SQL can give coefficients, errors and chi-square as means."""
    out = fits.harmonic_fit(_angles(spark, d), ["run"], "theta", "v", (2, 4))
    digits = {"red_chi2": 4} | {f"phase_{f}{e}": 5 for f in (2, 4) for e in ("", "_err")}
    return out.select("run", "n", *(F.round(c, digits.get(c, 6)).alias(c) for c in out.columns if c not in ("run", "n")))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY l_returnflag")
def linear_trend(spark, d):
    out = fits.linear_trend(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 8).alias("r2"))


@query(f"WITH {_RUNS}, x AS (SELECT run, v AS rho, power((h + 0.5) / 4, 2) AS u FROM runs), s AS (SELECT run, max(rho) AS rho0, sum(u) AS su, sum(u * rho) AS sur, sum(u * u) AS suu FROM x GROUP BY run) SELECT run, rho0, round(greatest(0, (su - sur / rho0) / suu), 7) AS a FROM s")
def majumdar_fit(spark, d):
    rows = table(spark, d, "runs").select("run", F.col("v").alias("rho"), (F.col("h") + 0.5).alias("m"), F.lit(4.0).alias("m0"))
    return fits.majumdar_fit(rows, ["run"]).withColumn("a", F.round("a", 7))


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio FROM lineitem")
def ratio_check(spark, d):
    out = fits.ratio_check(table(spark, d, "lineitem"), "l_extendedprice", "l_discount")
    return out.select("l_orderkey", "l_linenumber", "l_quantity", F.round("ratio", 4).alias("ratio"))


def _cubic(spark, d):
    """Points of a cubic per order status, from the orders' own keys."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 1009).cast("double").alias("x"))
    return rows.withColumn("y", 2 + 0.5 * F.col("x") - 0.003 * F.col("x") ** 2 + 1e-6 * F.col("x") ** 3 + F.length("o_orderstatus"))


@query("SELECT o_orderkey, round(3 + 0.5 * x - 0.003 * x * x + 1e-6 * x * x * x, 4) AS cheb FROM (SELECT o_orderkey, cast(o_orderkey % 1009 AS double) AS x FROM orders)")
def cheb_fit_and_eval(spark, d):
    """A fit of degree 15 to a cubic, read off at the points: the cubic itself."""
    rows = _cubic(spark, d)
    found = fits.cheb_fit(rows, ["o_orderstatus"], "x", "y", 15)
    return fits.cheb_eval(rows, found, ["o_orderstatus"], "x").select("o_orderkey", F.round("cheb", 4).alias("cheb"))


def _fields(spark, d):
    """Fields and model parameters from the parts: four temperatures, both signs of H and H = 0."""
    return table(spark, d, "part").selectExpr("p_partkey", "cast(array(2, 5, 10, 15)[p_partkey % 4] AS double) AS t", "cast((p_partkey % 21 - 10) * 7000 AS double) AS h", "0.3D AS d", "3.5D AS j", "0.0005D AS c", "1.2e22D AS n")


@query()
def solve_magnetization(spark, d):
    return fits.solve_magnetization(_fields(spark, d))


@query()
def brillouin_fit(spark, d):
    """Recovers J, C and n of magnetizations that the model made, with the varied parameters of each temperature, and the saturation."""
    rules = {10.0: ["j"], 15.0: ["j"], 5.0: ["j", "c"], 2.0: ["j", "c", "n"]}
    made = fits.solve_magnetization(_fields(spark, d))
    return fits.saturation(fits.brillouin_fit(made, ["t"], rules, {"j": 3.4, "c": 0.0005, "n": 1.2e22}))


def _solves(h: str = "h", m: str = "m"):
    """Whether a magnetization is the model's own at it, by column expressions apart from the solver."""
    off = F.abs(sc.model_magnetization(h, m, "d", "t", "j", "c", "n") - F.col(m))
    return off <= 1e-8 * (1 + F.abs(m))


@query("""WITH g AS (SELECT p_brand, 2.5 + avg(p_retailprice) % 100 / 100 AS j, cast([2, 5, 10, 15][cast(min(p_size) AS int) % 4 + 1] AS double) AS t FROM part GROUP BY p_brand)
    SELECT p_brand, t, round(j, 6) AS j, cast(k AS int) AS k, k * 10000.0::double AS h, true AS solved, true AS between, true AS flux FROM g, (SELECT unnest(range(0, 10)) AS k)""")
def extrapolate(spark, d):
    """Curves of parameters that differ by brand: each point solves the model, lies between the curves of parameters plus and minus their errors, and has its flux density."""
    groups = table(spark, d, "part").groupBy("p_brand").agg((2.5 + F.avg("p_retailprice") % 100 / 100).alias("j"), F.min("p_size").alias("size"))
    params = groups.selectExpr("p_brand", "j", "cast(array(2, 5, 10, 15)[cast(size AS int) % 4] AS double) AS t", "0.3D AS d", "0.0005D AS c", "1.2e22D AS n", "0.05D AS j_err", "1e-5D AS c_err", "1e20D AS n_err")
    out = fits.extrapolate(params)
    inside = (F.col("m_min") <= F.col("m")) & (F.col("m") <= F.col("m_max")) & (F.abs(F.col("m_err") - F.greatest(F.col("m_max") - F.col("m"), F.col("m") - F.col("m_min"))) <= 1e-9)
    flux = F.abs(F.col("b") - (F.col("h") + 4 * math.pi * 0.7 * F.col("m"))) <= 1e-6
    return out.select("p_brand", "t", F.round("j", 6).alias("j"), F.round(F.col("h") / 10000).cast("int").alias("k"), F.round("h", 3).alias("h"), _solves().alias("solved"), inside.alias("between"), flux.alias("flux"))


@query("SELECT p_partkey, true AS solved, cast(sign((p_partkey % 21 - 10) * 7000) AS int) AS direction FROM part")
def magnetization_residual(spark, d):
    """Puts the solved magnetization into the model again: both sides agree, and it points as the field does."""
    made = fits.solve_magnetization(_fields(spark, d))
    return made.select("p_partkey", _solves().alias("solved"), F.signum("m").cast("int").alias("direction"))


@query(f"""SELECT cast([2, 5, 10, 15][p_partkey % 4 + 1] AS double) AS t, 3.5::double AS j, 0.0005::double AS c, 1.2::double AS n, round(1.2e22 * 4 * {sc.MU_B!r}, 3) AS m0, count(*) AS points, true AS close FROM part GROUP BY 1""")
def recovered_parameters(spark, d):
    """The fit finds J, C and n that made the data, the saturation n (J + 1/2) mu_B, and a reduced chi-square of nothing."""
    out = brillouin_fit(spark, d)
    return out.select("t", F.round("j", 4).alias("j"), F.round("c", 7).alias("c"), F.round(F.col("n") / 1e22, 4).alias("n"), F.round("m0", 3).alias("m0"), "points", (F.col("red_chi2") < 1e-6).alias("close"))


@query("SELECT cast([2, 5, 10, 15][p_partkey % 4 + 1] AS double) AS t, 10::bigint AS points, 0.0::double AS at_zero, true AS solved, true AS between, 90000.0::double AS last FROM part GROUP BY 1")
def extrapolated_fit(spark, d):
    """Curves of the fitted parameters: nothing at field zero, every point a solution of the model, and the curve between those of parameters plus and minus their errors."""
    found = brillouin_fit(spark, d).withColumn("d", F.lit(0.3)).withColumns({"j_err": F.lit(0.05), "c_err": F.lit(1e-5), "n_err": F.lit(1e20)})
    grid = fits.extrapolate(found)
    inside = (F.col("m_min") <= F.col("m")) & (F.col("m") <= F.col("m_max")) & (F.col("m_err") >= 0)
    return grid.groupBy("t").agg(F.count(F.lit(1)).alias("points"), F.max(F.when(F.col("h") == 0, F.col("m"))).alias("at_zero"), F.every(_solves()).alias("solved"), F.every(inside).alias("between"), F.round(F.max("h"), 3).alias("last"))
