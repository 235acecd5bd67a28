"""Joins that hold with hot keys, and connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """rows joined to facts, which has each key once, with the rows of a key spread over `salts` join keys by the columns `spread`."""
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread_rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return spread_rows.join(copies, [*keys, "__salt"], how).drop("__salt")


def components(links: DataFrame, scratch: Scratch, jumps: int = 2) -> DataFrame:
    """(node, root) for each node of links (a, b): nodes that links connect, over any distance, have one root.

    In each turn every node points to its least neighbour or itself, chains of pointers are shortened, and links are redrawn between
    what nodes point to; equal ones and loops go. The links left shrink fast, hubs among them: the least neighbour is an aggregate with partial sums on
    the map side, and pointers are joined to hubs' links with salted keys. Each turn is a written table.
    """
    root: DataFrame | None = None
    edges = scratch.table(links.select("a", "b").where("a <> b").distinct(), "links")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        point = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("to"))
        point = scratch.table(point, "point")
        for _ in range(jumps):
            step = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            point = scratch.table(salted_join(point, step, ["to"], ["node"]).select("node", F.coalesce("next", "to").alias("to")), "point")
        if root is None:
            root = point.select("node", F.col("to").alias("root"))
        else:
            moved = salted_join(root, point.select(F.col("node").alias("root"), "to"), ["root"], ["node"])
            root = scratch.table(moved.select("node", F.coalesce("to", "root").alias("root")), "root")
        left = salted_join(edges, point.select(F.col("node").alias("a"), F.col("to").alias("ra")), ["a"], ["b"])
        left = salted_join(left, point.select(F.col("node").alias("b"), F.col("to").alias("rb")), ["b"], ["a"])
        edges = scratch.table(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "links")
    return root if root is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
