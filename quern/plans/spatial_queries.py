"""Queries on points of a map."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, spatial
from .registry import query
from .tables import cte, table

_BOTH = cte("properties", "fires")
_Q = f"(1 - {spatial.E2}) * (s / (1 - {spatial.E2} * s * s) - ln((1 - sqrt({spatial.E2}) * s) / (1 + sqrt({spatial.E2}) * s)) / (2 * sqrt({spatial.E2})))"


def _albers(name: str, columns: str) -> str:
    rho = f"{spatial.AXIS} * sqrt({spatial.CONST!r} - {spatial.CONE!r} * q) / {spatial.CONE!r}"
    theta = f"{spatial.CONE!r} * radians(lon + 96)"
    return f"{name}_m AS (SELECT {columns}, {rho} * sin({theta}) AS x_m, {spatial.RHO_0!r} - {rho} * cos({theta}) AS y_m FROM (SELECT *, {_Q} AS q FROM (SELECT *, sin(radians(lat)) AS s FROM {name})))"


_POINTS = f"{_BOTH}, {_albers('properties', 'prop_id')}, {_albers('fires', 'fire_id, sat_id, type, confidence')}, f AS (SELECT * FROM fires_m WHERE type = 0 AND confidence = 'h'), pair AS (SELECT prop_id, fire_id, sat_id, sqrt((p.x_m - f.x_m) ** 2 + (p.y_m - f.y_m) ** 2) AS dist FROM properties_m p JOIN f ON abs(p.x_m - f.x_m) <= 50000 AND abs(p.y_m - f.y_m) <= 50000 AND (p.x_m - f.x_m) ** 2 + (p.y_m - f.y_m) ** 2 <= 50000.0 ** 2)"
_SATS = ("F", "O", "P")


def _points(spark, d):
    props = spatial.to_albers(table(spark, d, "properties")).select("prop_id", "x_m", "y_m")
    fires = spatial.to_albers(table(spark, d, "fires").where("type = 0 AND confidence = 'h'")).select("fire_id", "sat_id", "x_m", "y_m")
    return props, fires


@query(f"WITH {_POINTS} SELECT prop_id, round(x_m, 2) AS x_m, round(y_m, 2) AS y_m FROM properties_m")
def to_albers(spark, d):
    return spatial.to_albers(table(spark, d, "properties")).select("prop_id", F.round("x_m", 2).alias("x_m"), F.round("y_m", 2).alias("y_m"))


@query(f"WITH {_POINTS} SELECT prop_id, count(*) AS n, round(sum(dist) / 1000, 3) AS km FROM pair GROUP BY prop_id")
def radius_join(spark, d):
    props, fires = _points(spark, d)
    return spatial.radius_totals(props, fires, 50_000.0, "prop_id").select("prop_id", "n", F.round(F.col("distance_m") / 1000, 3).alias("km"))


@query(f"WITH {_POINTS}, n AS (SELECT prop_id, arg_min(fire_id, (dist, fire_id)) AS fire_id, min(dist) AS dist FROM pair GROUP BY prop_id) SELECT prop_id, fire_id, round(dist, 3) AS distance_m FROM properties_m LEFT JOIN n USING (prop_id)")
def nearest(spark, d):
    props, fires = _points(spark, d)
    return spatial.nearest(props, fires, 50_000.0, "prop_id", "fire_id").withColumn("distance_m", F.round("distance_m", 3))


_SCORES = f"{_POINTS}, s AS (SELECT prop_id, sat_id, count(*) AS n, avg(dist) / 1000 AS km, sum(1 - dist / 50000) AS score FROM pair GROUP BY ALL), every AS (SELECT prop_id, unnest({list(_SATS)}) AS sat_id FROM properties_m)"


@query(f"WITH {_SCORES} SELECT prop_id, sat_id, coalesce(n, 0) AS n_fires, round(km, 5) AS avg_km, round(coalesce(score, 0), 6) AS score FROM every LEFT JOIN s USING (prop_id, sat_id)")
def risk_score(spark, d):
    props, fires = _points(spark, d)
    return spatial.risk_score(props, fires, satellites=_SATS).withColumns({"avg_km": F.round("avg_km", 5), "score": F.round("score", 6)})


@query(f"WITH {_SCORES}, z AS (SELECT prop_id, sat_id, coalesce(score, 0) AS score FROM every LEFT JOIN s USING (prop_id, sat_id)) SELECT prop_id, {', '.join(f'''round(max(CASE WHEN sat_id = '{s}' THEN score END), 6) AS score_{s}''' for s in _SATS)}, round(avg(score), 6) AS sat_avg FROM z GROUP BY prop_id")
def satellite_average(spark, d):
    props, fires = _points(spark, d)
    out = aggs.satellite_average(spatial.risk_score(props, fires, satellites=_SATS), "prop_id", _SATS)
    return out.select("prop_id", *(F.round(c, 6).alias(c) for c in (*(f"score_{s}" for s in _SATS), "sat_avg")))


@query(f"WITH {_POINTS} SELECT prop_id, cast(floor(x_m / 100000) AS bigint) * 1000 + cast(floor(y_m / 100000) AS bigint) AS poly_id FROM properties_m")
def points_in_polygons(spark, d):
    """Properties in squares of 100 km, given as polygons."""
    props, _ = _points(spark, d)
    square = props.selectExpr("cast(floor(x_m / 100000) AS bigint) AS i", "cast(floor(y_m / 100000) AS bigint) AS j").distinct()
    ring = F.array(*(F.struct(((F.col("i") + a) * 100000.0).alias("x"), ((F.col("j") + b) * 100000.0).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))))
    polygons = square.select((F.col("i") * 1000 + F.col("j")).alias("poly_id"), ring.alias("ring"))
    return spatial.points_in_polygons(props, polygons).select("prop_id", "poly_id")


_OCTAGON = [(1.0, 0.4), (0.4, 1.0), (-0.4, 1.0), (-1.0, 0.4), (-1.0, -0.4), (-0.4, -1.0), (0.4, -1.0), (1.0, -0.4)]


def _in_octagon(size: str) -> str:
    return f"abs(dx) < {size} AND abs(dy) < {size} AND abs(dx) + abs(dy) < 1.4 * {size}"


@query(f"""WITH {_POINTS}, c AS (SELECT prop_id AS poly_id, x_m AS cx, y_m AS cy, 30000.0 + prop_id % 7 * 20000 AS size FROM properties_m WHERE prop_id % 40 = 0), q AS (SELECT prop_id, poly_id, size, p.x_m - cx AS dx, p.y_m - cy AS dy FROM properties_m p JOIN c ON abs(p.x_m - cx) < size AND abs(p.y_m - cy) < size)
    SELECT prop_id, poly_id FROM q WHERE {_in_octagon('size')} AND (NOT ({_in_octagon('size * 0.6')}) OR {_in_octagon('size * 0.3')})""")
def points_in_rings(spark, d):
    """Properties in octagons with a hole that has an island, of 30 to 150 km around every fortieth property: polygons of three rings, off the grid of cells."""
    props, _ = _points(spark, d)
    ring = lambda k: F.array(*(F.struct((F.col("x_m") + a * k * F.col("size")).alias("x"), (F.col("y_m") + b * k * F.col("size")).alias("y")) for a, b in _OCTAGON))
    polygons = props.where("prop_id % 40 = 0").withColumn("size", 30000.0 + F.col("prop_id") % 7 * 20000)
    polygons = polygons.select(F.col("prop_id").alias("poly_id"), F.array(*(ring(k) for k in (1.0, 0.6, 0.3))).alias("rings"))
    return spatial.points_in_polygons(props, polygons, 10_000.0).select("prop_id", "poly_id")
