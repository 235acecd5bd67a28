"""Exact nearest rows by a metric index: rows are dealt to the nearest of some pivots and, within such a cell, to rings by distance from it; triangle inequalities leave rings out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

#: Pivots at most, rings of a cell at most, rows of a ring and queries that one task compares at once.
PIVOTS, RINGS, CROWD, BLOCK = 64, 1_000, 4_000, 2_000
#: Bounds are lowered by this part of the distances they come from, for rounding.
SLACK = 1e-9


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(rows: np.ndarray, at: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row from one point; equal rows have equal ones."""
    gap = rows - at
    return np.abs(gap).sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1))


class Index:
    """What every task knows of the training rows: pivots, and cell, count, least and greatest distance of each ring. At most PIVOTS x RINGS rings."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.pivots, self.metric = pivots, metric
        self.cell = self.count = np.zeros(0, np.int64)
        self.low = self.high = np.zeros(0)

    def from_pivots(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([_distances(rows, p, self.metric) for p in self.pivots], axis=1) if len(rows) else np.zeros((0, len(self.pivots)))

    def bounds(self, far: np.ndarray) -> np.ndarray:
        """Least distance that a ring's rows can have from points with these distances from the pivots."""
        own = far[:, self.cell]
        ring = np.maximum(own - self.high, self.low - own)
        # a row is no nearer to any pivot than to its own
        halves = (own - far.min(axis=1)[:, None]) / 2
        return np.maximum(0, np.maximum(ring, halves) - SLACK * (own + self.high))

    def first(self, bounds: np.ndarray, wanted: int) -> np.ndarray:
        """The rings of least bound that hold at least `wanted` rows, as flags."""
        order = np.argsort(bounds, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        taken = np.concatenate([np.ones((len(order), 1), bool), held[:, :-1] < wanted], axis=1)
        out = np.zeros_like(taken)
        np.put_along_axis(out, order, taken, axis=1)
        return out


def build(rows: DataFrame, metric: str, pivots: int = PIVOTS, rings: int = RINGS, crowd: int = CROWD) -> tuple[DataFrame, Index] | None:
    """Rows (with __t and __v) written with their cell and its distance, and the index; None without rows. Pivots are the rows of least hashed key, about the root of their number."""
    n = rows.count()
    if not n:
        return None
    found = rows.orderBy(F.xxhash64("__t"), "__t").limit(min(pivots, math.ceil(math.sqrt(n)))).select("__v").collect()
    index = Index(np.unique(np.array([r["__v"] for r in found], dtype=float), axis=0), metric)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = index.from_pivots(_vectors(b.column("__v")))
            cell = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], names=[*b.schema.names, "__cell", "__r"])

    placed = written(rows.mapInArrow(place, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("__cell int, __r double").fields])), "cells")
    parts = max(1, min(rings, math.ceil(n / len(index.pivots) / crowd)))
    if parts > 1:
        cuts = placed.groupBy("__cell").agg(F.percentile_approx("__r", [i / parts for i in range(1, parts)]).alias("__cuts"))  # a row for each pivot
        placed = placed.join(F.broadcast(written(cuts, "cuts")), "__cell").withColumn("__ring", F.size(F.filter(F.array_distinct("__cuts"), lambda c: c < F.col("__r")))).drop("__cuts")
    else:
        placed = placed.withColumn("__ring", F.lit(0))
    told = placed.groupBy("__cell", "__ring").agg(F.count(F.lit(1)).alias("n"), F.min("__r").alias("low"), F.max("__r").alias("high")).orderBy("__cell", "__ring").collect()
    index.cell, index.count = (np.array([r[c] for r in told], dtype=np.int64) for c in ("__cell", "n"))
    index.low, index.high = (np.array([r[c] for r in told], dtype=float) for c in ("low", "high"))
    numbers = rows.sparkSession.createDataFrame([(r["__cell"], r["__ring"], i) for i, r in enumerate(told)], "__cell int, __ring int, __bin int")
    return placed.join(F.broadcast(numbers), ["__cell", "__ring"]).drop("__cell", "__ring"), index


def _probes(query: DataFrame, index: Index, wanted: int, bounded: bool) -> DataFrame:
    """Rows (__q, __qa, __qv, __kth, __bin, __far): the rings that a query row is compared with. Without a bound the nearest ones that hold `wanted` rows; then all others that can hold a row within __kth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                far = index.from_pivots(_vectors(b.column("__qv")))
                bounds = index.bounds(far)
                flags = index.first(bounds, wanted)
                if bounded:
                    flags = ~flags & (bounds <= b.column("__kth").to_numpy(zero_copy_only=False)[:, None])
                row, ring = np.nonzero(flags)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(ring.astype(np.int32)), pa.array(far[row, index.cell[ring]])], names=[*b.schema.names, "__bin", "__far"])

    return query.mapInArrow(run, T.StructType([*query.schema.fields, *T.StructType.fromDDL("__bin int, __far double").fields]))


def _best(k: int, metric: str, keep: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of a block for each query row sent to it."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["__q", "__t", *keep, "__d"]
        types = [asked.schema.field("__q").type, rows.schema.field("__t").type, *(rows.schema.field(c).type for c in keep), pa.float64()]
        if not rows.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        here, r = _vectors(rows["__v"]), rows["__r"].to_numpy()
        rank = np.argsort(pc.sort_indices(rows["__t"].combine_chunks()).to_numpy())
        values = pc.unique(rows["__ta"].combine_chunks())
        group = pc.index_in(rows["__ta"].combine_chunks(), value_set=values).to_numpy(zero_copy_only=False)
        own = pc.fill_null(pc.index_in(asked["__qa"].combine_chunks(), value_set=values), -1).to_numpy(zero_copy_only=False)
        own = np.where(asked["__qa"].is_null().to_numpy(), -1, own)
        points, kth, far = _vectors(asked["__qv"]), asked["__kth"].to_numpy(), asked["__far"].to_numpy()
        of, at, dist = [], [], []
        for i, point in enumerate(points):
            near = np.flatnonzero((np.abs(r - far[i]) <= kth[i] + SLACK * (r + far[i])) & (group != own[i]))
            d = _distances(here[near], point, metric)
            if len(d) > k:
                some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                near, d = near[some], d[some]
            best = np.lexsort((rank[near], d))[:k]
            of.append(np.full(len(best), i))
            at.append(near[best])
            dist.append(d[best])
        of, at = pa.array(np.concatenate(of)), pa.array(np.concatenate(at))
        return pa.table([asked["__q"].take(of), rows["__t"].take(at), *(rows[c].take(at) for c in keep), pa.array(np.concatenate(dist))], names=names)

    return run


def _compared(placed: DataFrame, probes: DataFrame, index: Index, k: int, keep: Sequence[str], crowd: int, block: int) -> DataFrame:
    """Best rows of each block for each probe. A ring is cut into blocks of about `crowd` rows and its probes into blocks of about `block`, by hash, so no group grows with the tables."""
    sent = probes.groupBy("__bin").count().collect()  # a row for each ring at most
    many = [(r["__bin"], math.ceil(int(index.count[r["__bin"]]) / (2 * crowd)), math.ceil(r["count"] / block)) for r in sent]
    blocks = lambda: F.broadcast(probes.sparkSession.createDataFrame(many, "__bin int, __rows int, __asks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    rows = placed.join(blocks(), "__bin").withColumn("__tb", mine("__t", "__rows")).withColumn("__qb", every("__asks")).drop("__rows", "__asks")
    asked = probes.join(blocks(), "__bin").withColumn("__qb", mine("__q", "__asks")).withColumn("__tb", every("__rows")).drop("__rows", "__asks")
    schema = T.StructType([T.StructField("__q", probes.schema["__q"].dataType), *(placed.schema[c] for c in ("__t", *keep)), T.StructField("__d", T.DoubleType())])
    keys = ("__bin", "__tb", "__qb")
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_best(k, index.metric, keep), schema)


def nearest_rows(train: DataFrame, query: DataFrame, k: int, key: str, vector: str = "v", metric: str = "euclidean", keep: Sequence[str] = (), apart: str | None = None, pivots: int = PIVOTS, rings: int = RINGS, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Rows (__q, __t, columns `keep` of the training row, __d, __rn): the k nearest training rows of each query row, exactly, however many queries there are. Of equally near rows those with the smaller key come first.

    Training rows are read once, placed, and written; each query row is compared with the rings nearest to it that hold about 2 k rows, and then with those rings that can hold a row within its k-th
    distance so far. Rows whose values of `apart` are equal are not compared (missing ones are). Vectors are arrays of one length; rows without a key, a vector or one of its numbers take no part.
    """
    whole = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))))
    no_group = F.lit(None).cast("string")
    rows = whole(train).select(F.col(key).alias("__t"), *keep, (F.col(apart) if apart else no_group).alias("__ta"), F.col(vector).cast("array<double>").alias("__v"))
    asked = whole(query).select(F.col(key).alias("__q"), (F.col(apart) if apart else no_group).alias("__qa"), F.col(vector).cast("array<double>").alias("__qv"), F.lit(math.inf).alias("__kth"))
    first = Window.partitionBy("__q").orderBy("__d", "__t")
    top = lambda df: df.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= k)
    made = build(rows, metric, pivots, rings, crowd)
    if made is None:
        return top(rows.join(asked, F.lit(False)).select("__q", "__t", *keep, F.lit(0.0).alias("__d")))
    placed, index = made
    near = written(_probes(asked, index, 2 * (k + 1), bounded=False), "probes")
    found = written(top(_compared(placed, near, index, k, keep, crowd, block)), "near")
    kth = found.groupBy(F.col("__q").alias("__found")).agg(F.when(F.count(F.lit(1)) >= k, F.max("__d")).otherwise(math.inf).alias("__most"))
    again = asked.drop("__kth").join(kth, F.col("__q") == F.col("__found"), "left").select("__q", "__qa", "__qv", F.coalesce("__most", F.lit(math.inf)).alias("__kth"))
    more = written(_probes(again, index, 2 * (k + 1), bounded=True), "probes")
    return top(found.drop("__rn").unionByName(_compared(placed, more, index, k, keep, crowd, block)))
