"""Linear support vectors with the squared hinge loss, by a trust-region Newton method whose sums are aggregates; many settings and folds in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Features up to which a pass gathers the matrix of second derivatives; beyond it each product with a direction is a pass.
DENSE = 255


@dataclass
class Problem:
    """One setting of C, on all rows but those of fold `out` (None: on all)."""

    c: float
    out: int | None = None


class _Passes:
    """Sums over written rows (x, y, fold): each task adds up its own rows, for all problems at once, and Spark adds up the tasks' numbers. Only sums reach the driver."""

    def __init__(self, rows: DataFrame, problems: Sequence[Problem]):
        self.rows, self.problems, self.count = rows, problems, 0

    def run(self, at: dict[int, np.ndarray], dense: bool, along: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
        """For each problem of `at`: loss and gradient, then the second derivatives' upper half if `dense`; with `along` only the products of these with a direction."""
        problems, self.count = self.problems, self.count + 1

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
                for k, w in at.items():
                    here = slice(None) if problems[k].out is None else np.flatnonzero(fold != problems[k].out)
                    xs, ys = x[here], y[here]
                    gap = 1 - ys * (xs @ w)
                    on = gap > 0
                    xs, c = xs[on], 2 * problems[k].c
                    if along is not None:
                        told = c * (xs.T @ (xs @ along[k]))
                    else:
                        told = np.concatenate([[problems[k].c * (gap[on] ** 2).sum()], -c * (xs.T @ (ys[on] * gap[on]))])
                        if dense:
                            told = np.concatenate([told, (c * (xs.T @ xs))[np.triu_indices(len(w))]])
                    sums[k] = sums.get(k, 0) + told
            for k, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(s)], names=["k", "at", "s"])

        total = self.rows.mapInArrow(add, "k int, at int, s double").groupBy("k", "at").agg(F.sum("s").alias("s")).toPandas()
        d = len(next(iter(at.values())))
        size = d if along is not None else 1 + d + (d * (d + 1) // 2 if dense else 0)
        out = {k: np.zeros(size) for k in at}
        for k, i, s in total.itertuples(index=False):
            out[k][i] = s
        return out


def _step(g: np.ndarray, product, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """A step of conjugate gradients within the trust region, and the second derivatives' product with it."""
    s, hs, r = np.zeros_like(g), np.zeros_like(g), -g
    p, enough = r.copy(), 1e-10 * np.linalg.norm(g)
    for _ in range(4 * len(g) + 10):
        if np.linalg.norm(r) <= enough:
            break
        hp = product(p)
        a = (r @ r) / (p @ hp)
        if np.linalg.norm(s + a * p) >= radius:
            # to the border
            ps, pp, ss = p @ s, p @ p, s @ s
            a = (-ps + np.sqrt(max(ps * ps + pp * (radius * radius - ss), 0))) / pp
            return s + a * p, hs + a * hp
        s, hs, r_new = s + a * p, hs + a * hp, r - a * hp
        p, r = r_new + (r_new @ r_new) / (r @ r) * p, r_new
    return s, hs


def _solve(passes: _Passes, d: int, tolerance: float, most: int) -> list[np.ndarray]:
    """Weights of all problems, iterated in step: each turn is one pass (and one for each product where features are many) for those not yet solved."""
    dense, n = d <= DENSE, len(passes.problems)
    w = [np.zeros(d) for _ in range(n)]
    upper = np.triu_indices(d)

    def taken(told: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray | None]:
        h = None
        if dense:
            h = np.zeros((d, d))
            h[upper] = told[1 + d :]
            h = h + np.triu(h, 1).T + np.eye(d)
        return told[0] + at @ at / 2, told[1 : 1 + d] + at, h

    state = {k: taken(t, w[k]) for k, t in passes.run(dict(enumerate(w)), dense).items()}
    start = {k: np.linalg.norm(g) for k, (_, g, _) in state.items()}
    radius = dict(start)
    open_ = {k for k in state if start[k] > 0}
    for _ in range(most):
        if not open_:
            break
        steps = {}
        for k in open_:
            _, g, h = state[k]
            product = (lambda p, h=h: h @ p) if dense else (lambda p, k=k: p + passes.run({k: w[k]}, False, {k: p})[k])
            steps[k] = _step(g, product, radius[k])
        told = passes.run({k: w[k] + s for k, (s, _) in steps.items()}, dense)
        for k, (s, hs) in steps.items():
            f, g, _ = state[k]
            fresh = taken(told[k], w[k] + s)
            expected, got = -(g @ s + s @ hs / 2), f - fresh[0]
            ratio = got / expected if expected > 0 else 0.0
            size = np.linalg.norm(s)
            radius[k] = max(4 * size, radius[k]) if ratio > 0.75 else radius[k] if ratio > 0.25 else size / 4
            if ratio > 1e-4 or np.linalg.norm(fresh[1]) < np.linalg.norm(g):
                w[k], state[k] = w[k] + s, fresh
            elif expected <= 1e-15 * max(abs(f), 1.0):
                open_.discard(k)
        open_ -= {k for k in list(open_) if np.linalg.norm(state[k][1]) <= tolerance * start[k]}
    return w


@dataclass
class SquaredHingeSVC:
    """The chosen C, its weights and intercept on all rows, and (c, precision, fold precisions) of the search."""

    c: float
    coefficients: np.ndarray
    intercept: float
    search: list[tuple[float, float | None, list[float | None]]]

    def transform(self, df: DataFrame, vector: str = "x", name: str = "prediction") -> DataFrame:
        """Adds the predicted label 0 or 1, by built-in expressions."""
        margin = F.aggregate(F.zip_with(vector, F.lit([float(x) for x in self.coefficients]), lambda a, b: a * b), F.lit(float(self.intercept)), lambda s, x: s + x)
        return df.withColumn(name, F.when(F.col(vector).isNotNull(), (margin > 0).cast("int")))


def fit_squared_hinge(df: DataFrame, features: Sequence[str], label: str, key: str, c_values: Sequence[float] = (1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0), folds: int = 5, seed: int = 77, tolerance: float = 1e-10, most: int = 200) -> SquaredHingeSVC:
    """Linear support vectors: least |w|^2 / 2 + C sum max(0, 1 - y w.x)^2 with y = +-1 from a label 1 or 0, the intercept being the weight of a further feature 1; C by mean precision over
    `folds` folds (of several best the least), then fitted to all rows.

    Folds are by a hash of `key`, so they do not depend on partitioning. All C and folds take their Newton steps together: a turn is one pass over the written rows, of which each task sends
    one row of sums per number. Rows with a missing label or feature are left out. A fold without rows or without predicted positives has no precision and does not count.
    """
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*features, label)))
    x = F.array(*(F.col(c).cast("double") for c in features), F.lit(1.0))
    rows = written(whole.select(x.alias("x"), F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("y"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int").alias("fold")), "svc")
    problems = [Problem(c, k) for c in c_values for k in range(folds)] if len(c_values) > 1 and folds > 1 else []
    problems += [Problem(c) for c in c_values]
    w = _solve(_Passes(rows, problems), len(features) + 1, tolerance, most)
    search: list[tuple[float, float | None, list[float | None]]] = []
    if len(problems) > len(c_values):
        # margins of the held-out rows of each fold by its weights, for every C
        table = F.lit([[[float(v) for v in w[i * folds + k]] for k in range(folds)] for i in range(len(c_values))])
        margin = F.transform(table, lambda by: F.aggregate(F.zip_with("x", F.element_at(by, F.col("fold") + 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) > 0)
        told = rows.select("fold", "y", F.posexplode(margin).alias("c", "said")).where("said").groupBy("c", "fold").agg(F.avg((F.col("y") > 0).cast("double")).alias("p")).collect()
        by = {(r["c"], r["fold"]): r["p"] for r in told}
        for i, c in enumerate(c_values):
            each = [by.get((i, k)) for k in range(folds)]
            known = [p for p in each if p is not None]
            search.append((c, sum(known) / len(known) if known else None, each))
    best = max(range(len(c_values)), key=lambda i: (search[i][1] if search and search[i][1] is not None else -1.0, -c_values[i]))
    chosen = w[len(problems) - len(c_values) + best]
    return SquaredHingeSVC(c_values[best], chosen[:-1], float(chosen[-1]), search)
