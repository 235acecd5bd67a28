"""Tables that the queries run on: the given ones, and columns derived from them by expressions that read the same in Spark and in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> (given table, {column: expression})
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "houses": (
        "orders",
        {
            "house_id": "o_orderkey",
            "city": "CASE WHEN o_orderkey % 11 = 0 THEN '--' WHEN o_orderkey % 11 = 1 THEN NULL ELSE concat('City', cast(o_custkey % 5 AS string)) END",
            "sale_price": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END",
            "sale_date": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE cast(cast(o_orderdate AS date) AS string) END",
            "months_listed": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderkey % 240 AS double) / 8 END",
            "bedrooms": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE cast(o_orderkey % 5 + 2 AS int) END",
            "house_type": "CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 'Detached' WHEN o_orderkey % 6 = 1 THEN 'Det.' WHEN o_orderkey % 6 = 2 THEN 'Semi-detached' WHEN o_orderkey % 6 = 3 THEN 'Semi' WHEN o_orderkey % 6 = 4 THEN 'Terraced' ELSE 'Terr.' END",
            "area": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat(cast(o_orderkey % 200 + 50 AS string), ' sq.m.') END",
        },
    ),
    "recipes": (
        "customer",
        {
            "recipe": "c_custkey",
            "calories": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal + 1000 END",
            "protein": "CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE cast(c_custkey % 97 AS double) / 4 END",
            "category": "CASE WHEN c_custkey % 7 = 0 THEN 'Chicken Breast' WHEN c_custkey % 7 = 1 THEN 'Chicken' WHEN c_custkey % 7 = 2 THEN 'Potato' WHEN c_custkey % 7 = 3 THEN 'Pork' WHEN c_custkey % 7 = 4 THEN 'Beverages' WHEN c_custkey % 7 = 5 THEN 'Dessert' ELSE 'Mystery' END",
            "servings": "CASE WHEN c_custkey % 4 = 0 THEN '4 as a snack' ELSE cast(c_custkey % 4 * 2 AS string) END",
            "high_traffic": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'High' END",
        },
    ),
    "properties": (
        "customer",
        {
            "prop_id": "c_custkey",
            "lon": "-120 + cast(c_custkey * 7919 % 5000 AS double) / 500",
            "lat": "35 + cast(c_custkey * 104729 % 4000 AS double) / 800",
            "geoid": "concat(lpad(cast(c_nationkey % 9 + 1 AS string), 2, '0'), lpad(cast(c_nationkey AS string), 3, '0'), lpad(cast(c_custkey % 50 AS string), 6, '0'), lpad(cast(c_custkey % 9000 + 1000 AS string), 4, '0'))",
            "nation": "c_nationkey",
        },
    ),
    "fires": (
        "orders",
        {
            "fire_id": "o_orderkey",
            "lon": "CASE WHEN o_orderkey % 3 = 0 THEN cast(-118.5 AS double) + cast(o_orderkey % 100 AS double) / 1000 ELSE -120 + cast(o_orderkey * 6151 % 5000 AS double) / 500 END",
            "lat": "CASE WHEN o_orderkey % 3 = 0 THEN cast(37.5 AS double) + cast(o_orderkey % 77 AS double) / 1000 ELSE 35 + cast(o_orderkey * 3571 % 4000 AS double) / 800 END",
            "sat_id": "o_orderstatus",
            "acq_date": "cast(o_orderdate AS date)",
            "type": "CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 0 END",
            "confidence": "CASE WHEN o_orderkey % 4 = 0 THEN 'l' WHEN o_orderkey % 4 = 1 THEN 'n' ELSE 'h' END",
        },
    ),
    "runs": (
        "events",
        {
            "run": "user_id",
            "act": "event_type",
            "ts": "ts",
            "event_id": "event_id",
            "v": "value",
            "t": "cast(user_id % 4 + 2 AS int)",
            "h": "cast(event_id % 7 - 3 AS double)",
            "deg": "cast(event_id % 5 * 90 AS double) + cast(event_id % 11 - 5 AS double) / 2",
        },
    ),
}

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table of a folder."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, columns = DERIVED[name]
    return table(spark, sf_dir, source).selectExpr(*(f"{e} AS `{c}`" for c, e in columns.items()))


def cte(*names: str) -> str:
    """The same derived tables as SQL: `name AS (SELECT ...)`, to follow WITH."""
    return ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in DERIVED[n][1].items())} FROM {DERIVED[n][0]})" for n in names)
