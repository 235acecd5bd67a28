import datetime
import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import scalars as sc
from quern.operators import aggs, calendar_dim, clean, components, fits, joins, ml, neighbors, ordering, spatial, svm, windows
from quern.plans import fit_queries, spatial_queries
from quern.plans.tables import table
from quern.sources import io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fills_with_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, "a", None), (3, None, 4.5), (4, "a", 3.0), (5, "b", None)], "k int, s string, x double")
    assert {r.k: r.s for r in clean.fill_mode(df, "s").collect()}[3] == "a"  # a tie: the smaller value
    assert {r.k: r.x for r in clean.fill_mean(df, {"x": 1}).collect()}[2] == 3.2
    assert clean.fill_mode(df.limit(0), "s").count() == 0
    assert clean.fill_mean(df.where("x IS NULL"), {"x": 1}).where("x IS NULL").count() == 2
    assert clean.missing_report(df).collect() == clean.missing_report(df).collect()
    assert rows(clean.count_invalid(df, "s", ["a"])) == [(3,)]


def test_parse_domain_and_snap(spark):
    df = spark.createDataFrame([("120 sq.m.",), ("12Xsq.m",), (None,), ("7",)], "a string")
    assert rows(clean.parse_number(df, "a", "sq.m.")) == sorted([(120.0,), (None,), (None,), (7.0,)], key=repr)
    angles = spark.createDataFrame([(0.5,), (89.0,), (45.0,), (181.9,), (None,)], "deg double")
    assert rows(clean.snap_to_targets(angles, "deg", (0, 90, 180), 2)) == [(0.0,), (180.0,), (90.0,)]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a, b = (rows(clean.sample_n(df.repartition(n), "k", 20, seed=3)) for n in (1, 7))
    assert a == b and len(a) == 20
    assert clean.drop_n(df, "k", 20, seed=3).count() == 480
    train, test = ml.split(df, "k")
    assert train.intersect(test).count() == 0 and 60 < test.count() < 140


@settings(max_examples=25, deadline=None)
@given(st.floats(0.1, 5), st.floats(0.1, 5), st.floats(0.1, 5))
def test_demag_factors_sum_to_one(spark, a, b, c):
    got = spark.range(1).select(sc.demag_factor(a, b, c), sc.demag_factor(b, c, a), sc.demag_factor(c, a, b), sc.demag_factor(b, a, c)).first()
    assert math.isclose(got[0] + got[1] + got[2], 1, abs_tol=1e-7) and math.isclose(got[0], got[3], abs_tol=1e-8)


def test_cube_and_brillouin(spark):
    r = spark.range(1).select(sc.demag_factor(1, 1, 1), sc.brillouin(1e-6, 2.5), sc.brillouin(50, 2.5), sc.positive_phase(-0.5)).first()
    assert math.isclose(r[0], 1 / 3, abs_tol=1e-9) and math.isclose(r[1], 3.5e-6 / 7.5, rel_tol=1e-6)
    assert math.isclose(r[2], 1, abs_tol=1e-6) and math.isclose(r[3], 2 * math.pi - 0.5)


@pytest.mark.parametrize("start", [1, 4, 7])
def test_calendar_against_datetime(spark, start):
    df = spark.createDataFrame([(datetime.date(2023, 5, 1),), (datetime.date(2024, 2, 2),), (None,)], "d date")
    got = calendar_dim.date_dimension(df, "d", start).collect()
    assert len(got) == 365 + 366 and len(got[0]) == 28
    for r in got:
        d = r.date
        first = datetime.date(d.year, 1, 1)
        week = ((d - first).days + (first.weekday() + 1) % 7) // 7 + 1
        assert r.week_number == week and r.day_of_week == (d.weekday() + 1) % 7 + 1
        month = (d.month - start) % 12 + 1
        year = d.year + (start != 1 and d.month >= start)
        assert (r.fiscal_month, r.fiscal_quarter, r.fiscal_year) == (month, (month + 2) // 3, year)
    assert calendar_dim.date_dimension(df.limit(0), "d").count() == 0


def test_radius_join_is_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(-2e5, 2e5, (60, 2)), rng.uniform(-2e5, 2e5, (80, 2))
    b[:40] = rng.normal(0, 1e3, (40, 2))  # a dense cluster
    b[0] = a[0] + (5e4, 0)  # exactly at the radius
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "p int, x_m double, y_m double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "f int, x_m double, y_m double")
    got = {(r.p, r.f) for r in spatial.radius_join(left, right, 5e4).collect()}
    want = {(i, j) for i in range(60) for j in range(80) if (a[i, 0] - b[j, 0]) ** 2 + (a[i, 1] - b[j, 1]) ** 2 <= 25e8}
    assert got == want
    assert {(r.p, r.f) for r in spatial.radius_join(left, right, 5e4, crowd=7).collect()} == want  # the cluster is several keys
    every = spatial.risk_score(left.withColumnRenamed("p", "prop_id"), right.withColumn("sat_id", F.lit("S")))
    assert every.count() == 60 and every.agg(F.sum("n_fires")).first()[0] == len(want)
    scores = spatial.risk_score(left.withColumnRenamed("p", "prop_id"), right.withColumn("sat_id", F.lit("S")), satellites=["S", "T"]).collect()
    assert len(scores) == 120
    for r in scores:
        assert math.isclose(r.score, r.n_fires * (1 - (r.avg_km or 50) / 50), abs_tol=1e-6)


def test_albers_known_point(spark):
    df = spatial.to_albers(spark.createDataFrame([(-96.0, 23.0), (-75.0, 35.0)], "lon double, lat double")).collect()
    assert abs(df[0].x_m) < 1e-6 and abs(df[0].y_m) < 1e-6
    assert abs(df[1].x_m - 1885428.39) < 0.1 and abs(df[1].y_m - 1535969.29) < 0.1


def test_control_limits_do_not_depend_on_parts(spark):
    rng = random.Random(3)
    data = [(rng.choice(("a", "a", "a", None, "b")), rng.choice((None, *range(40))), i, rng.choice((None, 1.0, rng.random()))) for i in range(300)]
    df = spark.createDataFrame([*data, ("few", 1, 300, 2.0)], "k string, t int, i int, v double")
    want = rows(windows.control_limits(df, ["k"], ["t", "i"], "v"))
    assert len(want) == sum(max(0, sum(d[0] == k for d in data) - 4) for k in ("a", None, "b"))
    for most in (5, 33, 100):
        assert rows(windows.control_limits(df, ["k"], ["t", "i"], "v", most=most)) == want
    assert windows.control_limits(df.limit(0), ["k"], ["t", "i"], "v").count() == 0


def test_polygons_against_every_edge(spark):
    rng, shapes = random.Random(4), {}
    for k in range(12):
        cx, cy, n, big = rng.uniform(-60, 60), rng.uniform(-60, 60), rng.randint(3, 40), rng.choice((3, 20, 90))
        turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        shapes[k] = [(cx + big * r * math.cos(t), cy + big * r * math.sin(t)) for t in turn for r in (rng.uniform(0.2, 1),)]
    shapes[12] = [(float(x), float(y)) for x, y in ((-20, -20), (30, -20), (30, 40), (-20, 40))]  # borders on those of cells
    at = [(i, rng.uniform(-120, 120), rng.uniform(-120, 120)) for i in range(600)] + [(600 + i, float(10 * (i % 9) - 40), float(10 * (i // 9) - 40)) for i in range(81)]

    def holds(ring, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return odd

    want = sorted(((i, k) for i, x, y in at for k, ring in shapes.items() if holds(ring, x, y) for _ in range(2 if k == 3 else 1)), key=repr)
    more = [(3, shapes[3]), (20, []), (21, None), (22, [(0.0, 0.0), (5.0, 0.0)])]
    poly = spark.createDataFrame([*shapes.items(), *more], "poly_id int, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([*at, (999, None, 1.0)], "p int, x_m double, y_m double")
    for crowd in (100_000, 3):
        assert rows(spatial.points_in_polygons(pts, poly, 10.0, crowd).select("p", "poly_id")) == want
    assert spatial.points_in_polygons(pts, poly.limit(0), 10.0).count() == 0


def test_polygon_edges_and_holes_of_nothing(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 5.0, 5.0)], "p int, x_m double, y_m double")
    ring = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    poly = spark.createDataFrame([("a", ring(0.0)), ("b", ring(1.0))], "poly_id string, ring array<struct<x: double, y: double>>")
    assert rows(spatial.points_in_polygons(pts, poly, 10.0).select("p", "poly_id")) == [(1, "a"), (2, "b")]


def test_fourier_equals_sums_and_zero_signal(spark):
    rng = np.random.default_rng(1)
    data = [("x", i, float(v)) for i, v in enumerate(rng.normal(size=31))] + [("z", i, 0.0) for i in range(8)]
    df = spark.createDataFrame(data, "g string, o int, v double").repartition(3)
    a = {(r.g, r.freq): r for r in fits.fourier_by_group(df, ["g"], "o", "v", 6, 6).collect()}
    for r in fits.dft_at(df, ["g"], ["o"], "v", [1, 2, 3]).collect():
        assert math.isclose(a[r.g, r.freq].re, r.re, abs_tol=1e-10) and math.isclose(a[r.g, r.freq].im, r.im, abs_tol=1e-10)
    assert a["z", 0].amp_ratio is None


def test_fourier_query_orders_tied_times_by_whole_id(spark, tmp_path):
    spark.sql("SELECT id AS event_id, 1L AS user_id, 'a' AS event_type, timestamp '2024-01-01 00:00:00' AS ts, cast(id * id % 7 AS double) AS value FROM range(990, 1013) UNION ALL SELECT 2005, 1, 'a', timestamp '2024-01-01 00:00:00', 9.0").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.freq: r for r in fit_queries.fourier_by_group(spark, str(tmp_path)).collect()}
    want = np.fft.rfft([*(float(i * i % 7) for i in range(990, 1013)), 9.0], norm="ortho")
    assert len(got) == 4 and all(math.isclose(r.re, want[k].real, abs_tol=1e-6) and math.isclose(r.im, want[k].imag, abs_tol=1e-6) for k, r in got.items())


def test_fits_recover_parameters(spark):
    th = np.arange(0, 2 * np.pi, 0.05)
    v = 5 * (1 + 0.2 * np.sin(2 * th + 0.7) + 0.05 * np.sin(4 * th + 2.0))
    df = spark.createDataFrame([("a", float(t), float(x)) for t, x in zip(th, v, strict=True)], "g string, th double, v double")
    r = fits.harmonic_fit(df, ["g"], "th", "v").first()
    assert np.allclose([r["mean"], r.amp_2, r.phase_2, r.amp_4, r.phase_4], [5, 0.2, 0.7, 0.05, 2.0], atol=1e-8)
    model = spark.createDataFrame([(2.0, float(h), 0.3, 3.5, 5e-4, 1.2e22) for h in range(-70000, 70001, 5000)], "t double, h double, d double, j double, c double, n double")
    made = fits.solve_magnetization(model)
    for m in made.collect():
        assert abs(float(fits._model(*(np.float64(x) for x in (m.h, m.m, m.d, m.t, m.j, m.c, m.n)))) - m.m) < 1e-8
    f = fits.brillouin_fit(made, ["t"], {2.0: ["j", "c", "n"]}, {"j": 3.3, "c": 4e-4, "n": 1.25e22}).first()
    assert np.allclose([f.j, f.c, f.n], [3.5, 5e-4, 1.2e22], rtol=1e-3)
    x = np.linspace(0, 9e4, 200)
    curve = spark.createDataFrame([(1, float(a), float(2 + a / 3e4 - (a / 5e4) ** 3)) for a in x], "g int, x double, y double")
    found = fits.cheb_fit(curve, ["g"], "x", "y", 7)
    assert max(abs(r.cheb - r.y) for r in fits.cheb_eval(curve, found, ["g"], "x").collect()) < 1e-6
    line = fits.majumdar_fit(spark.createDataFrame([(1, 10.0 * (1 - 0.3 * (m / 4) ** 2), float(m)) for m in range(5)], "g int, rho double, m double").withColumn("m0", F.lit(4.0)), ["g"]).first()
    assert math.isclose(line.a, 0.3, abs_tol=1e-12)


def test_windows_and_unknown_names(spark):
    df = spark.createDataFrame([("e", 0.0, 1.0), ("e", 90.0, 3.0), ("e", 180.0, 2.0), ("f", 180.0, 9.0)], "act string, deg double, res double").withColumns({"t": F.lit(1), "h": F.lit(1.0), "b": F.col("res"), "d": F.lit(0.5)})
    got = {r.act: r for r in windows.demag_amplitudes(df).collect()}
    assert got["e"].delta_res == -1.0 and got["e"].amp_res == -0.5 and got["f"].delta_res is None
    meta = spark.createDataFrame([("t1", "all")], "table string, universe string")
    with pytest.raises(PySparkException):
        joins.universe_of(meta, spark.createDataFrame([("t2",)], "table string")).collect()
    assert aggs.precision_kpi(spark.createDataFrame([(1, 0)], "y int, p int"), "y", "p").first().precision is None
    assert rows(windows.score_category(spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "s double"), "s").groupBy("category").count().where("category IS NOT NULL")) == sorted([(k, 10) for k in range(1, 11)], key=repr)


def test_readers(spark, tmp_path):
    for name, text in (("ACTRot11_para_T1p9K_H0_5T_AMRO.csv", "a,b\n1,2\n"), ("ACTRot12_perp_T2K_H9T_AMRO.csv", "a,b\n3,4\n"), ("notes_T2K.csv", "a,b\n5,6\n")):
        (tmp_path / name).write_text(text)
    rules = {"t": (r"_T([0-9p_]+)K", "number"), "h": (r"_H([0-9_p]+)T", "number"), "act": (r"^(ACTRot\d+)_", "text")}
    got = io.read_tagged_files(spark, f"file://{tmp_path}", "a int, b int", rules, keep="AMRO")
    assert rows(got.select("a", "t", "h", "act")) == [(1, 1.9, 0.5, "ACTRot11"), (3, 2.0, 9.0, "ACTRot12")]
    with pytest.raises(PySparkException):
        io.read_tagged_files(spark, f"file://{tmp_path}", "a int, b int", {"h": rules["h"]}).collect()
    folder = tmp_path / "mag"
    os.mkdir(folder)
    (folder / "MvH5K.dat").write_text("\n".join(f"line {i}" for i in range(39)) + "\nT,H,X,M\n5.0,100,,0.1\n5.0,200,,0.2\n")
    got = io.read_instrument(spark, f"file://{folder}", "temp double, h double, x double, m double")
    assert got.columns == ["t", "temp", "h", "m"] and rows(got) == [(5, 5.0, 100.0, 0.1), (5, 5.0, 200.0, 0.2)]
    look = tmp_path / "level.csv"
    look.write_text("﻿RatingID,RatingLevel\n1,Bad \n2,Good\n", encoding="utf-8")
    assert rows(io.read_lookup(spark, f"file://{look}")) == [(1, "Bad"), (2, "Good")]
    meta = tmp_path / "meta.json"
    meta.write_text('[{"name": "B01", "universe": "people", "description": "d", "variables": "u"}]')
    assert rows(io.read_table_metadata(spark, f"file://{meta}")) == [("B01", "people", "d")]
    (tmp_path / "hot").mkdir()
    (tmp_path / "hot" / "fire_viirs_2020.csv").write_text("LATITUDE,LONGITUDE,ACQ_DATE,SATELLITE,CONFIDENCE,BRIGHT_T31,FRP,TYPE\n1,2,2020-01-02,N,h,3,4,0\n")
    assert io.read_hotspots(spark, f"file://{tmp_path}/hot").first().sat_id == "viirs"


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    wide = [float(v) for v in [*rng.normal(0, 1, 400), *np.exp(rng.normal(0, 20, 100)), -1e300, 1e300]]
    ties = [float(v) for v in rng.integers(0, 4, len(wide))]
    df = spark.createDataFrame([*zip(wide, ties, [None] * len(wide), strict=True), (None, float("nan"), None)], "a double, b double, c double").repartition(3)
    got = aggs.quantiles(df, ["a", "b", "c"], qs)
    assert np.allclose(got["a"], np.quantile(wide, qs), rtol=1e-12) and np.allclose(got["b"], np.quantile(ties, qs)) and got["c"] == [None] * 6
    assert aggs.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_quantiles_end_on_infinite_and_tiny_values(spark):
    inf, qs = math.inf, [0.0, 0.25, 0.5, 0.75, 1.0]
    cases = {"a": [1.0, 2.0, inf], "b": [-inf, -inf, inf], "c": [inf, inf, inf], "d": [-inf, 0.0, 5e-324], "e": [-1.7e308, 0.0, 1.7e308], "f": [float("nan"), 7.0, None]}
    df = spark.createDataFrame([tuple(v[i] for v in cases.values()) for i in range(3)], ", ".join(f"{c} double" for c in cases))
    got = aggs.quantiles(df, list(cases), qs)
    assert got["a"] == [1.0, 1.5, 2.0, inf, inf] and got["c"] == [inf] * 5 and got["f"] == [7.0] * 5
    assert got["b"][:3] == [-inf, -inf, -inf] and got["b"][4] == inf and math.isnan(got["b"][3])
    assert got["d"] == [-inf, -inf, 0.0, 5e-324 * 0.5, 5e-324] and got["e"] == [-1.7e308, -0.85e308, 0.0, 0.85e308, 1.7e308]
    assert {r.column: r["max"] for r in aggs.describe(df, ["a", "b"]).collect()} == {"a": inf, "b": inf}
    assert rows(windows.score_category(df, "a").select("a", "category")) == [(1.0, 1), (2.0, 5), (inf, 6)]


def test_histogram_by_number_of_bins(spark):
    rng = np.random.default_rng(2)
    v = [float(x) for x in rng.normal(size=500)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (math.inf,)], "a double")
    counts, edges = np.histogram(v, 7)
    got = sorted(aggs.histogram(df, "a", 7).collect(), key=lambda r: r.bin)
    assert [r.n for r in got] == counts.tolist() and np.allclose([r.lo for r in got] + [got[-1].hi], edges)
    assert [tuple(r) for r in aggs.histogram(spark.createDataFrame([(3.0,)] * 4, "a double"), "a", 2).collect()] == [(1, 3.0, 3.5, 4)]
    assert aggs.histogram(df.limit(0), "a", 4).count() == 0


def brute_neighbors(train, query, k, metric, skip):
    out = []
    for q, g, v in query:
        far = sorted((float(np.abs(np.subtract(v, w)).sum() if metric == "manhattan" else np.sqrt((np.subtract(v, w) ** 2).sum())), t) for t, h, w in train if not (skip and g is not None and g == h))
        out += [(q, t, round(d, 9)) for d, t in far[:k]]
    return sorted(out)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_nearest_rows_are_exact(spark, metric):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 5, (6, 3))
    train = [(i, i % 5 if i % 11 else None, [float(x) for x in centers[i % 6] + rng.normal(0, 0.3, 3)]) for i in range(600)]
    train[100:200] = [(i, 1, train[7][2]) for i in range(100, 200)]  # one place a hundred times: ties by key
    query = [(i, g, v) for i, g, v in train if i % 9 == 0] + [(1000, 1, [0.0, 0.0, 0.0]), (1001, None, train[7][2])]
    schema = "k long, g int, v array<double>"
    a = spark.createDataFrame([*train, (None, 1, [0.0] * 3), (700, 1, None), (701, 1, [None, 1.0, 2.0])], schema).repartition(3)
    b = spark.createDataFrame([*query, (1002, 1, None)], schema)
    for skip, sizes in ((None, {}), ("g", {}), ("g", {"crowd": 5, "block": 3, "pivots": 9})):
        got = neighbors.nearest_rows(a, b, 7, "k", metric=metric, apart=skip, **sizes)
        assert sorted((r["__q"], r["__t"], round(r["__d"], 9)) for r in got.collect()) == brute_neighbors(train, query, 7, metric, skip)
    assert neighbors.nearest_rows(a.limit(0), b, 7, "k").count() == 0 and neighbors.nearest_rows(a, b.limit(0), 7, "k").count() == 0
    few = neighbors.nearest_rows(a.where("k < 3"), b, 7, "k")
    assert few.count() == 3 * len(query)


def test_rings_are_left_out(spark):
    """On clustered rows most pairs are never compared."""
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 20, (30, 8))
    rows_ = spark.createDataFrame([(i, [float(x) for x in centers[i % 30] + rng.normal(0, 1, 8)]) for i in range(3000)], "__t long, __v array<double>")
    _, index = neighbors.build(rows_, "euclidean", crowd=20)
    asked = rows_.where("__t % 50 = 0").select(F.col("__t").alias("__q"), F.col("__v").alias("__qv"), F.lit(4.0).alias("__kth"))
    sent = neighbors._probes(asked, index, 16, bounded=True).groupBy("__bin").count().collect()
    assert sum(r["count"] * int(index.count[r["__bin"]]) for r in sent) < 0.35 * 60 * 3000


def test_numbers_of_large_keys(spark):
    rng = random.Random(7)
    data = [(rng.choice(("a", "a", "a", None, "b")), rng.choice((None, *range(9))), i) for i in range(400)]
    df = spark.createDataFrame([*data, ("few", 1, 400)], "k string, t int, i int").repartition(4)
    want = rows(ordering.numbered(df, ["k"], ["t", "i"]))
    assert [r[3] for r in want if r[0] == "few"] == [0]
    assert sorted(r[3] for r in want if r[0] is None) == list(range(sum(d[0] is None for d in data)))
    assert rows(ordering.numbered(df, ["k"], ["t", "i"], most=20)) == want
    assert ordering.numbered(df.limit(0), ["k"], ["t", "i"]).count() == 0


@pytest.mark.parametrize("n", [64, 97, 250, 1021])
def test_long_runs_in_many_tasks_equal_one(spark, n):
    rng = np.random.default_rng(n)
    v = [float(x) for x in rng.normal(2, 1, n)]
    v[3] = None
    df = spark.createDataFrame([("long", n, i, x) for i, x in enumerate(v)] + [("short", 2, i, float(i % 3)) for i in range(9)] + [(None, 1, i, 1.0) for i in range(5)], "g string, x int, o int, v double").repartition(4)
    near = {(r.g, r.freq): r for r in fits.fourier_by_group(df, ["g", "x"], "o", "v").collect()}
    got = {(r.g, r.freq): r for r in fits.fourier_by_group(df, ["g", "x"], "o", "v", most=20).collect()}
    assert near.keys() == got.keys() and sum(k[0] == "long" for k in got) == 10
    for k, r in got.items():
        assert np.allclose([r.re, r.im, r.mag, r.amp_ratio], [near[k].re, near[k].im, near[k].mag, near[k].amp_ratio], atol=1e-9)
        assert r.mag < 1e-9 or math.isclose(math.cos(r.phase - near[k].phase), 1, abs_tol=1e-9)
    few = {(r.g, r.freq): (r.re, r.im) for r in fits.dft_at(df, ["g", "x"], ["o"], "v", [0, 1, 4], most=20).collect()}
    for r in fits.dft_at(df, ["g", "x"], ["o"], "v", [0, 1, 4]).collect():
        assert np.allclose(few[r.g, r.freq], (r.re, r.im), atol=1e-9)


def test_a_run_of_a_million_rows_is_several_tasks(spark):
    n = 1_000_003  # a prime
    df = spark.range(n).select(F.lit("x").alias("g"), F.col("id").alias("o"), (F.sin(2 * math.pi * 7 * F.col("id") / n) * 3 + 1).alias("v"))
    got = {r.freq: r for r in fits.fourier_by_group(df, ["g"], "o", "v", most=1 << 18).collect()}
    assert math.isclose(got[7].mag, 1.5 * math.sqrt(n), rel_tol=1e-9) and got[7].amp_ratio == 1.0
    assert math.isclose(got[0].re, math.sqrt(n), rel_tol=1e-9) and got[3].mag < 1e-5
    parts, _ = ordering.in_parts(df, ["g"], ["o"], 1 << 18)
    assert parts.select("__part").distinct().count() > 1


def test_brillouin_fit_of_a_large_group(spark):
    """10^6 distinct fields at one temperature; several groups, of which some vary a part of the parameters, in step."""
    made = spark.range(1_000_000).repartition(4).select(F.lit(2.0).alias("t"), ((F.col("id") - 500_000) * 0.14).alias("h"), F.lit(0.3).alias("d"), F.lit(3.5).alias("j"), F.lit(5e-4).alias("c"), F.lit(1.2e22).alias("n"))
    few = spark.createDataFrame([(t, float(h), 0.3, 3.5, 5e-4, 1.2e22) for t in (5.0, 10.0) for h in range(-70000, 70001, 7000)], made.schema)
    df = fits.solve_magnetization(made.unionByName(few)).withColumn("m", F.col("m") + F.when(F.col("t") == 5.0, F.pmod(F.xxhash64("h"), F.lit(1000)) / 1000 - 0.5).otherwise(0.0))
    got = {r.t: r for r in fits.brillouin_fit(df, ["t"], {2.0: ["j", "c", "n"], 5.0: ["j", "c"], 10.0: ["j"]}, {"j": 3.3, "c": 5e-4, "n": 1.2e22}).collect()}
    assert np.allclose([got[2.0].j, got[2.0].c, got[2.0].n], [3.5, 5e-4, 1.2e22], rtol=1e-5) and got[2.0].points == 1_000_000
    assert math.isclose(got[10.0].j, 3.5, rel_tol=1e-6) and got[10.0].c_err == got[10.0].n_err == got[5.0].n_err == 0
    assert got[5.0].j_err > 0 and abs(got[5.0].j - 3.5) < 6 * got[5.0].j_err
    assert fits.brillouin_fit(df.limit(0), ["t"], {}, {"j": 3.3, "c": 5e-4, "n": 1.2e22}).count() == 0


def dense_squared_hinge(x, y, c):
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(500):
        gap = 1 - y * (x @ w)
        on = gap > 0
        g = w - 2 * c * x[on].T @ (y[on] * gap[on])
        if np.linalg.norm(g) < 1e-12:
            break
        step, t = np.linalg.solve(np.eye(len(w)) + 2 * c * x[on].T @ x[on], -g), 1.0
        f = lambda v: v @ v / 2 + c * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        while f(w + t * step) > f(w) + 1e-4 * t * (g @ step) and t > 1e-10:
            t /= 2
        w = w + t * step
    return w


@pytest.mark.parametrize("dense", [255, 1])
def test_squared_hinge_equals_a_dense_solve(spark, monkeypatch, dense):
    monkeypatch.setattr(svm, "DENSE", dense)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    label = (x @ [1.0, -2.0, 0.3] + rng.normal(0, 0.7, 300) + 0.4 > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, label, strict=True))] + [(999, None, 1.0, 1.0, 1)], "k int, a double, b double, c double, y int").repartition(3)
    for c in (1e-3, 1.0, 100.0) if dense > 1 else (1.0,):
        model = svm.fit_squared_hinge(df, ["a", "b", "c"], "y", "k", (c,), folds=1)
        assert np.allclose([*model.coefficients, model.intercept], dense_squared_hinge(x, 2.0 * label - 1, c), atol=1e-6)
    if dense > 1:
        model = svm.fit_squared_hinge(df, ["a", "b", "c"], "y", "k")
        assert [s[0] for s in model.search] == [1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0] and all(len(s[2]) == 5 for s in model.search)
        said = model.transform(df.where("a IS NOT NULL").withColumn("x", F.array("a", "b", "c"))).agg(F.avg(F.when(F.col("prediction") == 1, F.col("y"))).alias("p"), F.avg("y").alias("all")).first()
        assert said.p > 0.8 > said["all"]
        assert np.allclose(model.coefficients, dense_squared_hinge(x, 2.0 * label - 1, model.c)[:-1], atol=1e-6)


def join_tasks(df):
    """Tasks with rows of the stage that makes pairs: partitions of the joined rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_crowded_cells_are_several_tasks(spark):
    """One split on each side, one crowded cell: the pairs are made in more than one task."""
    left = spark.range(50).select(F.col("id").alias("p"), (F.col("id") * 10.0).alias("x_m"), F.lit(0.0).alias("y_m")).coalesce(1)
    right = spark.range(3000).select(F.col("id").alias("f"), (F.col("id") % 100 * 5.0).alias("x_m"), F.lit(7.0).alias("y_m")).coalesce(1)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = spatial.radius_join(left, right, 5e4, crowd=300)
        assert join_tasks(pairs) > 1 and pairs.count() == 150_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    both = spatial.radius_join(left, right, 5e4, crowd=20)  # crowded on both sides
    assert both.count() == both.distinct().count() == 150_000


def shuffled_rows(spark, job):
    """Rows that a job's stages write to shuffles."""
    jvm = spark.sparkContext._gateway.jvm

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    job()
    return sum(n for stage, n in total().items() if stage not in before)


def test_radius_totals_pair_places(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(-4, 5, (200, 2)) * 2e4, rng.integers(-4, 5, (300, 2)) * 2e4 + (3e3, 4e3)  # several rows of a place on both sides
    b[0] = a[0] + (3e4, 4e4)  # exactly at the radius
    left = spark.createDataFrame([(i % 190 or None, float(x), float(y)) for i, (x, y) in enumerate(a)] + [(500, None, 1.0), (501, 9e6, 0.0)], "p int, x_m double, y_m double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)] + [(500, None, 1.0)], "f int, x_m double, y_m double")
    want = {}
    for i, at in enumerate(a):
        far = np.sqrt(((b - at) ** 2).sum(axis=1))
        n, total = want.get(i % 190 or None, (0, 0.0))
        if (far <= 5e4).any():
            want[i % 190 or None] = (n + int((far <= 5e4).sum()), total + float(far[far <= 5e4].sum()))
    got = {r.p: (r.n, r.distance_m) for r in spatial.radius_totals(left, right, 5e4, "p").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and math.isclose(got[k][1], d, rel_tol=1e-12) for k, (n, d) in want.items())
    assert spatial.radius_totals(left, right.limit(0), 5e4, "p").count() == 0


def test_crowded_places_of_a_radius_are_not_repeated(spark, tmp_path):
    """20,000 properties of one place and 20,000 fires of another in its reach: the query's shuffles hold rows of either side a few times, not once for every part of the other side."""
    spark.range(20_000).select((F.col("id") * 20_000 + 2243).alias("c_custkey"), F.lit(1).alias("c_nationkey")).write.parquet(f"file://{tmp_path}/customer.parquet")
    orders = spark.range(20_000).select((F.col("id") * 60_000 + 20_002).alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.lit("2024-01-01").cast("timestamp").alias("o_orderdate"))
    orders.write.parquet(f"file://{tmp_path}/orders.parquet")
    n = []
    assert shuffled_rows(spark, lambda: n.extend(spatial_queries.radius_join(spark, f"file://{tmp_path}").select("n", "km").distinct().collect())) < 100_000
    fires = table(spark, f"file://{tmp_path}", "fires").where("type = 0 AND confidence = 'h'").count()
    assert len(n) == 1 and n[0].n == fires > 10_000


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(8)
    a = rng.uniform(-2e5, 2e5, (150, 2))
    b = np.concatenate([rng.uniform(-2e5, 2e5, (100, 2)), rng.normal(0, 800, (300, 2)), np.tile(a[5] + (30.0, 40.0), (20, 1)), [a[9] + (3e4, 4e4)]])
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)] + [(900, None, 1.0)], "p int, x_m double, y_m double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)] + [(901, None, 1.0)], "f int, x_m double, y_m double")
    want = {900: (None, None)}
    for i, at in enumerate(a):
        far = np.sqrt(((b - at) ** 2).sum(axis=1))
        want[i] = (int(far.argmin()), round(float(far.min()), 6)) if far.min() <= 5e4 else (None, None)
    for halvings in (0, 3, 8):
        got = spatial.nearest(left, right, 5e4, "p", "f", halvings).collect()
        assert {r.p: (r.f, r.distance_m and round(r.distance_m, 6)) for r in got} == want
    assert all(r.f is None for r in spatial.nearest(left, right.limit(0), 5e4, "p", "f").collect())


def test_holes_and_islands(spark):
    def circle(r, n=60, cx=0.3, cy=0.7):
        return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n)]

    shapes = {"ring": [circle(90), circle(50), circle(20)], "plain": [circle(70, cx=40.0)], "none": [[], None], "null": None, "square": [[(-100.0, -100.0), (100.0, -100.0), (100.0, 100.0), (-100.0, 100.0)], [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)]]}
    rng = random.Random(2)
    at = [(i, rng.uniform(-130, 130), rng.uniform(-130, 130)) for i in range(1500)] + [(2000 + i, float(10 * (i % 23) - 110), float(10 * (i // 23) - 110)) for i in range(23 * 23)]

    def odd(rings, x, y):
        out = False
        for ring in rings or []:
            for (x1, y1), (x2, y2) in zip(ring or [], (ring or [])[1:] + (ring or [])[:1], strict=True):
                out ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return out

    want = sorted((i, k) for i, x, y in at for k, rings in shapes.items() if odd(rings, x, y))
    poly = spark.createDataFrame(list(shapes.items()), "poly_id string, rings array<array<struct<x: double, y: double>>>")
    pts = spark.createDataFrame(at, "p int, x_m double, y_m double")
    for cell, crowd in ((5.0, 100_000), (5.0, 4), (300.0, 100_000)):
        assert sorted(tuple(r) for r in spatial.points_in_polygons(pts, poly, cell, crowd).select("p", "poly_id").collect()) == want
    big = spark.createDataFrame([("big", [circle(50 * math.sqrt(4 / math.pi), 400)])], poly.schema)
    cells, runs = spatial.polygon_cover(big, 1.0)  # 10^4 cells inside
    assert cells.count() < 800 and runs.count() < 400


def test_places_and_shapes_are_tested_once(spark, monkeypatch):
    """Rows of a place and polygons of equal rings: each pair of rows is in the result, but cells and shuffles do not grow with the rows that are equal."""
    square = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    shapes = [[square(0.3, 0.2, 30.0 + 10 * k), square(0.3, 0.2, 12.0)] for k in range(5)]
    at = [(13.7 * k - 61, 9.1 * k - 40) for k in range(10)]
    inside = {(i, k) for i, (x, y) in enumerate(at) for k in range(5) if 12 < max(abs(x - 0.3), abs(y - 0.2)) < 30 + 10 * k}
    kind = "poly_id int, rings array<array<struct<x: double, y: double>>>"
    poly = spark.createDataFrame([(k, rings) for k, rings in enumerate(shapes)], kind)
    pts = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(at)], "at int, x_m double, y_m double")
    many = spark.range(1000).crossJoin(poly).select((F.col("id") * 5 + F.col("poly_id")).alias("poly_id"), "rings")
    rows_of = spark.range(200).crossJoin(pts).select((F.col("id") * 10 + F.col("at")).alias("p"), F.create_map(F.lit("k"), F.lit(1)).alias("m"), "x_m", "y_m")
    got = []
    query = lambda: got.extend(spatial.points_in_polygons(rows_of, many, 5.0).groupBy(F.expr("p % 10").alias("i"), F.expr("poly_id % 5").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p", "poly_id").alias("d")).collect())
    monkeypatch.setattr(spatial, "GATHERED", 100)  # places are several parts, and so are shapes
    assert shuffled_rows(spark, lambda: [c.count() for c in spatial.polygon_cover(many, 5.0)]) < 60_000
    query()
    assert {(r.i, r.k) for r in got} == inside and all(r.n == r.d == 200_000 for r in got)
    assert spatial.points_in_polygons(pts.drop("at"), poly, 5.0).columns == ["x_m", "y_m", "poly_id"]
    assert rows(spatial.points_in_polygons(pts.drop("at"), poly, 5.0)) == sorted(((*at[i], k) for i, k in inside), key=repr)


def test_polygons_without_an_id_and_equal_rows(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5)] * 3 + [(None, 0.5, 0.5), (2, 25.0, 25.0), (3, 90.0, 0.0)], "p int, x_m double, y_m double")
    ring = [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)]
    poly = spark.createDataFrame([(None, ring), (7, ring), (7, ring), (8, None), (None, [])], "poly_id int, ring array<struct<x: double, y: double>>")
    for cell in (5.0, 500.0):  # inside a run, and in cells with an outline
        assert rows(spatial.points_in_polygons(pts, poly, cell).select("p", "poly_id")) == sorted(((p, k) for p in (1, 1, 1, None, 2) for k in (None, 7, 7)), key=repr)


def test_near_equal_points_are_brute_force(spark):
    rng = random.Random(11)
    for tol in (0.25, 1.0):
        at = [(rng.uniform(-6, 6), rng.uniform(-6, 6)) for _ in range(90)] + [(3 + 0.2 * k, 8 + 0.2 * k) for k in range(12)] + [(-8 + 0.2 * k, -8 - 0.2 * k) for k in range(12)]
        at += at[:5]
        group = list(range(len(at)))
        for _ in at:
            for a, (x, y) in enumerate(at):
                for b, (u, v) in enumerate(at):
                    if abs(x - u) <= tol and abs(y - v) <= tol:
                        group[a] = group[b] = min(group[a], group[b])
        least = {}
        for k, g in enumerate(group):
            least[g] = min(least.get(g, at[k]), at[k])
        df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(at)] + [(500, None, 1.0), (501, None, 1.0)], "k int, lon double, lat double").repartition(3)
        got = clean.near_equal_groups(df, tol).collect()
        assert {r.k: r.place and tuple(r.place) for r in got} == {k: least[g] for k, g in enumerate(group)} | {500: None, 501: None}
        assert sorted(r.k for r in clean.dedupe_near(df, tol).where("lon IS NOT NULL").collect()) == sorted(min(k for k, p in enumerate(at) if p == x) for x in least.values())
        assert clean.dedupe_near(df, tol).where("lon IS NULL").count() == 2
    assert clean.near_equal_groups(df.limit(0), 1.0).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(((F.col("id") * 11) % 301).alias("a"), ((F.col("id") * 11 + 11) % 301).alias("b")).union(spark.createDataFrame([(400, 401), (401, 402), (402, 400), (9, 9)], "a long, b long"))
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(301)} | {400: 400, 401: 400, 402: 400}
    assert components.components(links.where("a = b")).count() == 0


def test_instrument_files_over_several_splits(spark, tmp_path):
    (tmp_path / "MvH5K.dat").write_text("\n".join(f"line {i}" for i in range(39)) + "\nT,H,X,M\n" + "\n".join(f"5.0,{i},,{i / 2}" for i in range(4000)) + "\n")
    (tmp_path / "MvH2K.dat").write_text("\r\n".join("long " * 40 for i in range(39)) + "\r\nT,H,X,M\r\n2.0,1,,7\r\n\r\n2.0,2,,8")
    (tmp_path / "MvH9K.dat").write_text("too short\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 20
        got = rows(io.read_instrument(spark, f"file://{tmp_path}", "temp double, h double, x double, m double"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted([(5, 5.0, float(i), i / 2) for i in range(4000)] + [(2, 2.0, 1.0, 7.0), (2, 2.0, 2.0, 8.0)], key=repr)


def test_models_beat_a_constant(spark):
    """Each model finds a signal that is there: better than the mean, or than calling all rows positive."""
    df = spark.range(240).select("id", ((F.col("id") * 37) % 100 / 100).alias("a"), ((F.col("id") * 61) % 100 / 100).alias("b"))
    df = df.withColumn("noise", (F.xxhash64("id") % 100) / 1000).withColumn("label", 3 * F.col("a") - F.col("b") * F.col("b") + F.col("noise"))
    data = ml.assemble(df, ["a", "b"]).cache()
    train, test = ml.split(data, "id")
    spread = test.agg(F.stddev_pop("label")).first()[0]
    for model in (ml.fit_random_forest(train, trees=(10,), depths=(5,), folds=2), ml.fit_gbt(train, trees=20, rate=0.1), ml.fit_gbt(train, draws=2, folds=2)):
        assert aggs.rmse(model.transform(test), "label", "prediction").first().rmse < 0.5 * spread
    yes = data.withColumn("label", (F.col("label") > 1.2).cast("double"))
    share = yes.agg(F.avg("label")).first()[0]
    for model in (ml.fit_logistic(yes, c_values=(1.0, 100.0), penalties=(0.0,), folds=2), ml.fit_linear_svc(yes, c_values=(1.0, 100.0), folds=2)):
        told = aggs.precision_kpi(model.transform(yes).withColumn("hat", F.col("prediction").cast("int")), "label", "hat").first()
        assert told.precision > share + 0.2
    with pytest.raises(Exception, match="null"):
        ml.assemble(df.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), ["a", "b"]).collect()
