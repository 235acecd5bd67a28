"""Connected components of link tables, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Keys that the rows of one key are spread over where many point to it.
SALTS = 16


def _looked_up(rows: DataFrame, key: str, facts: DataFrame, own: str) -> DataFrame:
    """rows with the column `found` of facts (`key`, found), which have each key once; the rows of a key are spread by `own`."""
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")).join(copies, [key, "__salt"], "left").drop("__salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): the least node that links lead to, over any distance.

    In each round every node hooks on to the least of its neighbours if that is less, chains of hooks are shortened to their ends, and links are redrawn between the ends; links within one end go. Ends fall by half
    at least, so rounds grow with the logarithm of the nodes.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    root: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hook = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")), "hooks")
        while True:
            ends = hook.select(F.col("node").alias("to"), F.col("to").alias("found"))
            step = written(_looked_up(hook, "to", ends, "node").select("node", F.col("found").alias("to"), (F.col("found") != F.col("to")).alias("moved")), "hooks")
            hook = step.select("node", "to")
            if step.where("moved").isEmpty():
                break
        if root is None:
            root = hook.select("node", F.col("to").alias("root"))
        else:
            moved = _looked_up(root, "root", hook.select(F.col("node").alias("root"), F.col("to").alias("found")), "node")
            root = written(moved.select("node", F.coalesce("found", "root").alias("root")), "roots")
        at = lambda c: hook.select(F.col("node").alias(c), F.col("to").alias("found"))  # noqa: E731, B023
        left = _looked_up(edges, "a", at("a"), "b").select(F.col("found").alias("a"), "b")
        left = _looked_up(left, "b", at("b"), "a").select("a", F.col("found").alias("b"))
        edges = written(left.where("a <> b").distinct(), "links")
    return root if root is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
