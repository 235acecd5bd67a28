"""Cleaning: fills, canonical values, domains, numbers in text, near-equal points, repeatable samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .components import components


def select_renamed(df: DataFrame, renames: Mapping[str, str], cols: Sequence[str] | None = None) -> DataFrame:
    """Renames columns, then keeps `cols` in that order (all if None)."""
    out = df.withColumnsRenamed(dict(renames))
    return out.select(*cols) if cols else out


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Missing values become the given constant of the column's own type."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in values.items()})


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drops rows with a missing value in any of `cols` (in any column if None)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def _one_row(df: DataFrame, stats: Mapping[str, Column]) -> DataFrame:
    return F.broadcast(df.agg(*(c.alias(n) for n, c in stats.items())))  # one row by construction


def fill_mean(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Missing values become the column's mean, rounded half to even; all means are taken in one pass."""
    means = _one_row(df, {f"__mean_{c}": F.bround(F.avg(c), d) for c, d in digits.items()})
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.crossJoin(means).withColumns({c: F.coalesce(F.col(c), F.col(f"__mean_{c}").cast(kinds[c])) for c in digits}).drop(*(f"__mean_{c}" for c in digits))


def fill_mode(df: DataFrame, col: str) -> DataFrame:
    """Missing values become the most common one, the smallest of several."""
    return df.crossJoin(_one_row(df, {"__mode": F.mode(col, True)})).withColumn(col, F.coalesce(col, "__mode")).drop("__mode")


def canonicalize(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replaces spellings by the value meant; others stay."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumn(col, F.coalesce(F.try_element_at(pairs, F.col(col)), F.col(col)))


def enforce_domain(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Values outside the list become missing."""
    return df.withColumn(col, F.when(F.col(col).isin(*values), F.col(col)))


def parse_number(df: DataFrame, col: str, suffix: str, kind: str = "double") -> DataFrame:
    """Takes a literal suffix off a text and reads the number before it; what is no number becomes missing."""
    return df.withColumn(col, F.trim(F.replace(F.col(col), F.lit(suffix), F.lit(""))).try_cast(kind))


def count_invalid(df: DataFrame, col: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """One row: how many values are missing or, with a list, outside it."""
    bad = F.col(col).isNull()
    if allowed is not None:
        bad = bad | ~F.col(col).isin(*allowed)
    return df.agg(F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_invalid"))


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, n_missing), all counted in one pass."""
    cols = list(cols or df.columns)
    counts = df.agg(*(F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in cols))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in cols))).alias("x")).select("x.*")


def snap_to_targets(df: DataFrame, col: str, targets: Sequence[float], tol: float) -> DataFrame:
    """Keeps rows within `tol` of a target and sets the column to it."""
    near = F.array_min(F.array(*(F.struct(F.abs(F.col(col) - t).alias("off"), F.lit(float(t)).alias("at")) for t in targets)))
    return df.withColumn("__near", near).where(F.col("__near.off") < tol).withColumn(col, F.col("__near.at")).drop("__near")


def dedupe_points(df: DataFrame, lon: str = "lon", lat: str = "lat", digits: int = 4) -> DataFrame:
    """One row per rounded coordinate pair: the first in the order of all columns. Points on the two sides of a rounding edge stay apart."""
    cols = df.columns
    first = F.min(F.struct(*cols)).alias("row")
    return df.groupBy(F.round(lon, digits).alias("__x"), F.round(lat, digits).alias("__y")).agg(first).select("row.*")


def near_equal_groups(df: DataFrame, tolerance: float, lon: str = "lon", lat: str = "lat", name: str = "place") -> DataFrame:
    """Adds a struct (lon, lat): the least place of the row's group. Places are of one group if steps of at most `tolerance` in either coordinate lead from one to the other over places of the table, also across the edges that
    rounding would draw. Missing coordinates have a missing place.

    Places of a cell as wide as the tolerance are one group without comparing them. Neighbouring cells side by side meet if their nearest columns or rows do, which two extremes tell; cells corner to corner
    if any place of one is within reach of any of the other in both coordinates, which one sorted pass over both cells tells. Linked cells are connected by rounds of joins. No pairs of places are made.
    """
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    at = [F.floor(c / tolerance).cast("long") for c in (x, y)]
    places = written(df.where(x.isNotNull() & y.isNotNull() & (F.abs(x) < math.inf) & (F.abs(y) < math.inf)).select(x.alias("x"), y.alias("y"), at[0].alias("i"), at[1].alias("j")).distinct(), "places")
    cells = places.groupBy("i", "j").agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in ((1, F.min), (2, F.max))), F.min(F.struct("x", "y")).alias("least"))
    cells = written(cells, "cells")
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    i, j = F.col("i"), F.col("j")
    links = None
    for di, dj, c in ((1, 0, "x"), (0, 1, "y")):
        other = cells.select((i - di).alias("i"), (j - dj).alias("j"), F.col(f"{c}1").alias("near"))
        some = cells.join(other, ["i", "j"]).where(F.col("near") - F.col(f"{c}2") <= tolerance).select(cell(i, j).alias("a"), cell(i + di, j + dj).alias("b"))
        links = some if links is None else links.unionByName(some)
    for turn in (1, -1):  # up and to the right, down and to the right
        pairs = cells.select("i", "j").join(cells.select((i - 1).alias("i"), (j - turn).alias("j")), ["i", "j"])
        here = places.join(pairs, ["i", "j"]).select("i", "j", (F.col("x") + tolerance).alias("by"), F.lit(1).alias("kind"), (turn * F.col("y") + tolerance).alias("v"))
        there = places.select((i - 1).alias("i"), (j - turn).alias("j"), "x", "y").join(pairs, ["i", "j"]).select("i", "j", F.col("x").alias("by"), F.lit(0).alias("kind"), (turn * F.col("y")).alias("v"))
        passed = F.min(F.when(F.col("kind") == 0, F.col("v"))).over(Window.partitionBy("i", "j").orderBy("by", "kind"))
        met = here.unionByName(there).withColumn("least", passed).where("kind = 1 AND least <= v").select("i", "j").distinct()
        links = links.unionByName(met.select(cell(i, j).alias("a"), cell(i + 1, j + turn).alias("b")))
    roots = components(links).select("node.i", "node.j", "root")
    known = cells.join(roots, ["i", "j"], "left").select("i", "j", F.coalesce("root", cell(i, j)).alias("root"), "least")
    least = known.groupBy("root").agg(F.min("least").alias("__least"))
    first = known.join(least, "root").select(F.col("i").alias("__i"), F.col("j").alias("__j"), F.struct(F.col("__least.x").alias("lon"), F.col("__least.y").alias("lat")).alias(name))
    return df.withColumns({"__i": at[0], "__j": at[1]}).join(first, ["__i", "__j"], "left").drop("__i", "__j")


def dedupe_near(df: DataFrame, tolerance: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row for each group of near-equal points (see near_equal_groups): the first by longitude, latitude and then all columns. Rows without a coordinate all stay."""
    grouped = near_equal_groups(df, tolerance, lon, lat, "__place")
    first = F.min(F.struct(F.col(lon).alias("__lon"), F.col(lat).alias("__lat"), F.struct(*df.columns).alias("row"))).alias("first")
    one = grouped.where("__place IS NOT NULL").groupBy("__place").agg(first).select("first.row.*")
    return one.unionByName(grouped.where("__place IS NULL").select(*df.columns))


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def address_hash(df: DataFrame, cols: Sequence[str], name: str = "address_id") -> DataFrame:
    """Adds a key of an address: SHA-256 over its trimmed, lower-cased parts."""
    return df.withColumn(name, F.sha2(F.concat_ws("|", *(F.lower(F.trim(F.col(c).cast("string"))) for c in cols)), 256))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows chosen by a hash of the key: the same rows however the table is partitioned."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def drop_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All rows but the n that sample_n takes."""
    return df.join(sample_n(df, key, n, seed).select(key), key, "left_anti")


def by_state(df: DataFrame, state: str, col: str = "state_id") -> DataFrame:
    return df.where(F.col(col) == state)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


# Spellings and categories of the house and recipe tables.
HOUSE_TYPES = ("Detached", "Semi-detached", "Terraced")
HOUSE_SPELLINGS = {"Det.": "Detached", "Semi": "Semi-detached", "Terr.": "Terraced"}
RECIPE_CATEGORIES = ("Lunch/Snacks", "Beverages", "Potato", "Vegetable", "Meat", "Chicken", "Pork", "Dessert", "Breakfast", "One Dish Meal")


def clean_houses(df: DataFrame) -> DataFrame:
    """House sales by the stated rules: unknown city, no row without a price, first day of 2023 for a missing date, rounded means, the commonest type, area as a number."""
    out = canonicalize(fill_constant(df, {"city": "Unknown"}), "city", {"--": "Unknown"})
    out = drop_missing(out, ["sale_price"])
    out = out.withColumn("sale_date", F.coalesce(F.to_date("sale_date"), F.lit("2023-01-01").cast("date")))
    out = enforce_domain(canonicalize(out, "house_type", HOUSE_SPELLINGS), "house_type", HOUSE_TYPES)
    out = parse_number(out, "area", "sq.m.")
    return fill_mode(fill_mean(out, {"months_listed": 1, "bedrooms": 0, "area": 1}), "house_type")


def clean_recipes(df: DataFrame) -> DataFrame:
    """Recipes: missing traffic is low, rows without nutrients go, servings as a number, categories of the list only."""
    out = drop_missing(fill_constant(df, {"high_traffic": "Low"}))
    out = out.withColumn("servings", F.regexp_extract("servings", r"^\s*(\d+)", 1).try_cast(T.IntegerType()))
    return enforce_domain(canonicalize(out, "category", {"Chicken Breast": "Chicken"}), "category", RECIPE_CATEGORIES)
