"""Fourier transforms and fits over many independent groups. Where a fit is linear, its sums are aggregates, so that a large group is no one task's work."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import K_B, MU_B, flux_density, lande_g, positive_phase
from ..sources.shared import written
from .ordering import FEW, MOST, before_parts, in_parts


def _fields(df: DataFrame, keys: Sequence[str], added: str) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(added).fields])


def _flat(keys: Sequence[str], rows: pa.Table, **columns: np.ndarray) -> pa.Table:
    """Rows of one group's arrays with its keys."""
    n = len(next(iter(columns.values())))
    return pa.table({**{k: pa.array([rows[k][0].as_py()] * n, rows.schema.field(k).type) for k in keys}, **columns})


def _power_fft(rows: DataFrame, keys: Sequence[str], lanes: int = 64) -> DataFrame:
    """The discrete transform of each key's `size` numbers re, im at j (missing ones are 0), size a power of two: rows (keys, size, j, re, im) again.

    Decimated: the numbers whose places leave one remainder are transformed by themselves, about the root of `size` of them; these transforms, turned by their remainder's factors, are transformed
    across remainders, `lanes` frequencies in a group. So no group is larger than about lanes x the root of `size`.
    """
    schema = _fields(rows, keys, "size long, r long, q long, re double, im double")
    parts = lambda size: (1 << ((size.bit_length() - 1) // 2), size >> ((size.bit_length() - 1) // 2))

    def within(table: pa.Table) -> pa.Table:
        size, r = table["size"][0].as_py(), table["r"][0].as_py()
        s, m = parts(size)
        z = np.zeros(m, complex)
        z[table["j"].to_numpy() // s] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        q = np.arange(m)
        z = np.fft.fft(z) * np.exp(-2j * np.pi * ((r * q) % size) / size)
        return _flat(keys, table, size=np.full(m, size), r=np.full(m, r), q=q, re=z.real, im=z.imag)

    def across(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        s, m = parts(size)
        q, r = table["q"].to_numpy(), table["r"].to_numpy()
        own = np.unique(q)
        z = np.zeros((s, len(own)), complex)
        z[r, np.searchsorted(own, q)] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        z = np.fft.fft(z, axis=0)
        j = own[None, :] + m * np.arange(s)[:, None]
        return _flat(keys, table, size=np.full(j.size, size), j=j.ravel(), re=z.real.ravel(), im=z.imag.ravel())

    # the remainder's divisor is the power of two of half the size's exponent
    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor((F.length(F.bin("size")) - 1) / 2).cast("int"))
    first = rows.select(*keys, "size", "j", "re", "im", (F.col("j") % half).alias("r")).groupBy(*keys, "r").applyInArrow(within, schema)
    second = first.withColumn("lane", F.floor(F.col("q") / lanes)).groupBy(*keys, "lane")
    return second.applyInArrow(across, _fields(rows, keys, "size long, j long, re double, im double"))


def _wide_spectrum(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half spectra (keys, freq, re, im) of long runs given as (keys, j, n, v), of any length n: the chirp transform, that is a circular convolution by three transforms of a power of two, each over many tasks. Runs have less than 3e9 rows."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(2 * F.col("n") - 2)).cast("int"))
    rows = rows.withColumn("size", size)
    turn = lambda sign: (lambda j, n: sign * math.pi * ((j * j) % (2 * n)) / n)
    minus, plus = turn(-1.0)(F.col("j"), F.col("n")), turn(1.0)(F.least("j", F.col("size") - F.col("j")), F.col("n"))
    given = rows.select(*keys, F.lit("a").alias("what"), "size", "j", (F.col("v") * F.cos(minus)).alias("re"), (F.col("v") * F.sin(minus)).alias("im"))
    chirps = rows.where("j = 0").select(*keys, "n", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / 1024))).alias("block"))
    chirps = chirps.select(*keys, "n", "size", F.explode(F.sequence(F.col("block") * 1024, F.col("block") * 1024 + 1023)).alias("j")).where("j < size AND least(j, size - j) < n")
    chirps = chirps.select(*keys, F.lit("b").alias("what"), "size", "j", F.cos(plus).alias("re"), F.sin(plus).alias("im"))
    both = _power_fft(given.unionByName(chirps), [*keys, "what"])
    pick = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    pairs = both.groupBy(*keys, "size", "j").agg(*(pick(w, c).alias(f"{w}{c}") for w in "ab" for c in ("re", "im")))
    # the inverse transform is that of the conjugate
    product = pairs.select(*keys, "size", "j", (F.col("are") * F.col("bre") - F.col("aim") * F.col("bim")).alias("re"), (-(F.col("are") * F.col("bim") + F.col("aim") * F.col("bre"))).alias("im"))
    back = written(_power_fft(product, keys), "spectrum")
    lengths = written(rows.where("j = 0").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "n"), "lengths")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    z = back.join(F.broadcast(lengths), same).where(F.col("j") <= F.floor(F.col("n") / 2))
    c, s, scale = F.cos(minus), F.sin(minus), F.col("size") * F.sqrt("n")
    return z.select(*keys, F.col("j").alias("freq"), ((F.col("re") * c + F.col("im") * s) / scale).alias("re"), ((F.col("re") * s - F.col("im") * c) / scale).alias("im"))


def fourier_by_group(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], value: str, max_freq: int = 10, n: int = 10, most: int = 1 << 18) -> DataFrame:
    """The strongest n bins below max_freq of the orthonormal real transform of each group: freq, re, im, mag, phase in [0, 2 pi), amp_ratio to the largest of all bins.

    A group is one measurement run, evenly spaced in `order`, a column or several. Missing values count as 0. A zero signal has missing ratios. Runs of at most `most` rows are sorted and
    transformed in a task each; longer ones are numbered in parts and transformed over many tasks, whatever their length (see _wide_spectrum).
    """

    by = [order] if isinstance(order, str) else list(order)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in by])
        v = np.nan_to_num(table[value].to_numpy(zero_copy_only=False).astype(float))
        z = np.fft.rfft(v, norm="ortho")
        mag = np.abs(z)
        phase = np.angle(z)
        freq = np.arange(len(z))
        some = np.flatnonzero(freq < max_freq)
        some = some[np.lexsort((some, -mag[some]))][:n]
        top = mag.max(initial=0)
        columns = [pa.array([table[k][0].as_py()] * len(some), table.schema.field(k).type) for k in keys]
        columns += [pa.array(freq[some].astype(np.int32)), pa.array(z.real[some]), pa.array(z.imag[some]), pa.array(mag[some]), pa.array(np.where(phase < 0, phase + 2 * np.pi, phase)[some])]
        return pa.Table.from_arrays([*columns, pa.array(mag[some] / top if top > 0 else [None] * len(some), pa.float64())], schema=None, names=[*keys, "freq", "re", "im", "mag", "phase", "amp_ratio"])

    schema = _fields(df, keys, "freq int, re double, im double, mag double, phase double, amp_ratio double")
    rows, several = in_parts(df.select(*dict.fromkeys([*keys, *by, value])), keys, by, most)
    short = rows.where("__part = 0").drop("__part").groupBy(*keys).applyInArrow(run, schema)
    if not several:
        return short
    long = _placed(rows.where("__part > 0"), keys, by, value)
    w = Window.partitionBy(*keys)
    bins = written(_wide_spectrum(long, keys).withColumn("mag", F.hypot("re", "im")), "bins")
    top = bins.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.max("mag").alias("__top"))
    some = bins.where(F.col("freq") < max_freq).join(top, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    some = some.withColumn("__rn", F.row_number().over(w.orderBy(F.desc("mag"), "freq"))).where(F.col("__rn") <= n)
    ratio = F.when(F.col("__top") > 0, F.col("mag") / F.col("__top"))
    return short.unionByName(some.select(*keys, F.col("freq").cast("int").alias("freq"), "re", "im", "mag", positive_phase(F.atan2("im", "re")).alias("phase"), ratio.alias("amp_ratio")))


def _placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Written rows (keys, j, n, v) of keys in parts, which in_parts made: place from 0, length of the run, value (0 for missing)."""
    at = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1
    rows = before_parts(rows, keys, {"__before": F.count(F.lit(1))})
    v = F.col(value).cast("double")
    rows = written(rows.select(*keys, (at + F.col("__before")).cast("long").alias("j"), F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v).alias("v")), "placed")
    lengths = rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(lengths, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]).select(*keys, "j", "n", "v")


def dft_at(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, freqs: Sequence[int], most: int = MOST) -> DataFrame:
    """The same transform at given frequencies, as plain sums: rows (keys, freq, re, im, mag, phase). Runs of more than `most` rows are numbered in parts."""
    rows, several = in_parts(df.select(*dict.fromkeys([*keys, *order, value])), keys, order, most)
    w = Window.partitionBy(*keys)
    placed = rows.where("__part = 0").select(*keys, F.coalesce(value, F.lit(0.0)).alias("v"), (F.row_number().over(w.orderBy(*order)) - 1).cast("long").alias("j"), F.count(F.lit(1)).over(w).alias("n"))
    if several:
        placed = placed.unionByName(_placed(rows.where("__part > 0"), keys, order, value))
    angle = lambda k: 2 * math.pi * k * F.col("j") / F.col("n")
    sums = [s for k in freqs for s in (F.sum(F.col("v") * F.cos(angle(k))).alias(f"c{k}"), F.sum(-F.col("v") * F.sin(angle(k))).alias(f"s{k}"))]
    out = placed.groupBy(*keys).agg(F.sqrt(F.count(F.lit(1))).alias("root"), *sums)
    bins = F.array(*(F.struct(F.lit(k).alias("freq"), (F.col(f"c{k}") / F.col("root")).alias("re"), (F.col(f"s{k}") / F.col("root")).alias("im")) for k in freqs))
    flat = out.select(*keys, F.explode(bins).alias("__bin")).select(*keys, "__bin.*")
    return flat.withColumns({"mag": F.hypot("re", "im"), "phase": positive_phase(F.atan2("im", "re"))})


def _normal_sums(basis: Sequence[Column], y: Column) -> list[Column]:
    p = len(basis)
    return [F.sum(basis[i] * basis[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(b * y).alias(f"y{i}") for i, b in enumerate(basis)] + [F.sum(y * y).alias("yy"), F.count(y).alias("n")]


def _solved(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, inverse normal matrices, residual sums of squares and counts of rows of normal sums."""
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
    a, b = np.zeros((batch.num_rows, p, p)), np.stack([get(f"y{i}") for i in range(p)], axis=1)
    for i in range(p):
        for j in range(i, p):
            a[:, i, j] = a[:, j, i] = get(f"x{i}_{j}")
    inverse = np.linalg.pinv(a, rcond=1e-13, hermitian=True)
    coef = np.einsum("kij,kj->ki", inverse, b)
    rss = np.maximum(get("yy") - 2 * np.einsum("ki,ki->k", coef, b) + np.einsum("ki,kij,kj->k", coef, a, coef), 0)
    return coef, inverse, rss, get("n")


def harmonic_fit(df: DataFrame, keys: Sequence[str], theta: str, value: str, freqs: Sequence[int] = (2, 4, 6, 8)) -> DataFrame:
    """Least squares of mean * (1 + sum a sin(f theta + phase)) at fixed frequencies: per group mean, mean_err, red_chi2, n, and for each frequency amp, amp_err, phase, phase_err.

    The model is linear in (mean, A sin, B cos), so each group is its normal sums, taken with partial sums before the shuffle, and a small solve.
    Missing values count as 0.
    """
    t, basis = F.col(theta), [F.lit(1.0)]
    for f in freqs:
        basis += [F.sin(f * t), F.cos(f * t)]
    p = len(basis)
    sums = df.where(t.isNotNull()).groupBy(*keys).agg(*_normal_sums(basis, F.coalesce(F.col(value).cast("double"), F.lit(0.0))))
    names = [x for f in freqs for x in (f"amp_{f}", f"amp_{f}_err", f"phase_{f}", f"phase_{f}_err")]
    schema = _fields(df, keys, "mean double, mean_err double, red_chi2 double, n long, " + ", ".join(f"{x} double" for x in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coef, inverse, rss, n = _solved(batch, p)
            chi2 = rss / np.maximum(n - p, 1)
            cov = inverse * chi2[:, None, None]
            m = coef[:, 0]
            out = [m, np.sqrt(np.maximum(cov[:, 0, 0], 0)), chi2, n.astype(np.int64)]
            with np.errstate(divide="ignore", invalid="ignore"):
                for k in range(len(freqs)):
                    i, j = 1 + 2 * k, 2 + 2 * k
                    a, b = coef[:, i], coef[:, j]
                    r = np.hypot(a, b)
                    amp = np.zeros((len(m), p))
                    amp[:, 0], amp[:, i], amp[:, j] = -r / m**2, a / (r * m), b / (r * m)
                    ph = np.zeros((len(m), p))
                    ph[:, i], ph[:, j] = -b / r**2, a / r**2
                    phase = np.arctan2(b, a)
                    err = lambda g: np.sqrt(np.maximum(np.einsum("ki,kij,kj->k", np.nan_to_num(g), cov, np.nan_to_num(g)), 0))
                    out += [r / m, err(amp), np.where(phase < 0, phase + 2 * np.pi, phase), err(ph)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(x) for x in out)], names=[*keys, "mean", "mean_err", "red_chi2", "n", *names])

    return sums.mapInArrow(run, schema)


def _chebyshev(x: Column, degree: int) -> list[Column]:
    out = [F.lit(1.0), x]
    for _ in range(degree - 1):
        out.append(2 * x * out[-1] - out[-2])
    return out[: degree + 1]


def cheb_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, deg: int = 15) -> DataFrame:
    """Chebyshev least squares of y over x scaled to [-1, 1] per group: lo, hi (the scale), coeffs, rms residual, n. Sums are aggregates, as in harmonic_fit."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    scale = rows.groupBy(*keys).agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    u = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(2 * F.col(x) - F.col("lo") - F.col("hi"), F.col("hi") - F.col("lo")), F.lit(0.0)))))
    scaled = rows.join(scale, list(keys)).withColumn("__u", u)
    # T_i T_j = (T_{i+j} + T_{|i-j|}) / 2, so 2 deg + 1 sums make the whole normal matrix
    moments = [F.sum(F.cos(k * F.col("__u"))).alias(f"m{k}") for k in range(2 * deg + 1)]
    right = [F.sum(F.cos(k * F.col("__u")) * F.col(y)).alias(f"y{k}") for k in range(deg + 1)]
    sums = scaled.groupBy(*keys, "lo", "hi").agg(*moments, *right, F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(y).alias("n"))
    schema = _fields(df, keys, "lo double, hi double, coeffs array<double>, rms double, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False).astype(float)
            m = np.stack([get(f"m{k}") for k in range(2 * deg + 1)], axis=1)
            i, j = np.indices((deg + 1, deg + 1))
            a = (m[:, i + j] + m[:, np.abs(i - j)]) / 2
            b = np.stack([get(f"y{k}") for k in range(deg + 1)], axis=1)
            coef = np.einsum("kij,kj->ki", np.linalg.pinv(a, rcond=1e-13, hermitian=True), b)
            rss = np.maximum(get("yy") - 2 * np.einsum("ki,ki->k", coef, b) + np.einsum("ki,kij,kj->k", coef, a, coef), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("lo"), batch.column("hi"), pa.array(coef.tolist(), pa.list_(pa.float64())), pa.array(np.sqrt(rss / get("n"))), batch.column("n")], names=[*keys, "lo", "hi", "coeffs", "rms", "n"])

    return sums.mapInArrow(run, schema)


def cheb_eval(df: DataFrame, fits: DataFrame, keys: Sequence[str], x: str, name: str = "cheb") -> DataFrame:
    """Adds the value of the group's fit at x, by Clenshaw's recurrence over the coefficient array."""
    u = F.coalesce(F.try_divide(2 * F.col(x) - F.col("lo") - F.col("hi"), F.col("hi") - F.col("lo")), F.lit(0.0))
    joined = df.join(fits.select(*keys, "lo", "hi", "coeffs"), list(keys)).withColumn("__u", u)
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    step = lambda s, c: F.struct((c + 2 * F.col("__u") * s["a"] - s["b"]).alias("a"), s["a"].alias("b"))
    tail = F.reverse(F.slice("coeffs", F.lit(2), F.size("coeffs") - 1))
    s = F.aggregate(tail, start, step)
    return joined.withColumn(name, F.col("coeffs")[0] + F.col("__u") * s["a"] - s["b"]).drop("__u", "lo", "hi", "coeffs")


def solve_magnetization(df: DataFrame, h: str = "h", d: str = "d", t: str = "t", j: str = "j", c: str = "c", n: str = "n", name: str = "m") -> DataFrame:
    """Adds the self-consistent magnetization: the root of model(H, M) = M, by bisection and secant steps on whole batches. 0 at H = 0, odd in H; missing inputs give a missing one."""
    schema, names, given = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]), [*df.columns, name], (h, d, t, j, c, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [batch.column(x).to_numpy(zero_copy_only=False).astype(float) for x in given]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(magnetization(*v), from_pandas=True)], names=names)

    return df.mapInArrow(run, schema)


def _brillouin(x: np.ndarray, j: np.ndarray) -> np.ndarray:
    small = np.abs(x) < 1e-4
    y = np.where(small, 1.0, x)
    p, q = (2 * j + 1) / (2 * j), 1 / (2 * j)
    with np.errstate(over="ignore"):
        return np.where(small, (j + 1) * x / (3 * j), p / np.tanh(p * y) - q / np.tanh(q * y))


def _model(h, m, d, t, j, c, n) -> np.ndarray:
    mu = (1.5 + (0.75 - (j - 0.5) * (j + 0.5)) / (2 * j * (j + 1))) * MU_B * j
    return n * mu * _brillouin(mu * (h + 4 * np.pi * (1 - d) * m) / (K_B * t), j) + c * h


def magnetization(h, d, t, j, c, n) -> np.ndarray:
    """Roots of model(H, M) = M for arrays of inputs, in a bracket from 0 to saturation."""
    h, d, t, j, c, n = np.broadcast_arrays(*(np.asarray(x, dtype=float) for x in (h, d, t, j, c, n)))
    a = np.abs(h)
    mu = (1.5 + (0.75 - (j - 0.5) * (j + 0.5)) / (2 * j * (j + 1))) * MU_B * j
    lo, hi = np.zeros(a.shape), n * np.abs(mu) + np.abs(c) * a + 1e-9
    off = lambda m: _model(a, m, d, t, j, c, n) - m
    f_lo, f_hi = off(lo), off(hi)
    for k in range(200):
        with np.errstate(divide="ignore", invalid="ignore"):
            mid = np.where((k % 3 == 0) | (f_hi == f_lo), (lo + hi) / 2, lo - f_lo * (hi - lo) / (f_hi - f_lo))
        mid = np.clip(np.where(np.isfinite(mid), mid, (lo + hi) / 2), lo, hi)
        f = off(mid)
        up = f > 0
        lo, f_lo = np.where(up, mid, lo), np.where(up, f, f_lo)
        hi, f_hi = np.where(up, hi, mid), np.where(up, f_hi, f)
        if np.nanmax(hi - lo, initial=0) < 1e-13 * max(1.0, float(np.nanmax(hi, initial=0))):
            break
    root = np.where(np.abs(f_lo) < np.abs(f_hi), lo, hi)
    return np.where(h == 0, 0.0, np.sign(h) * root) + 0 * (h + d + t + j + c + n)


_UPPER = ("jj", "jc", "jn", "cc", "cn", "nn")
_STATE = "qj double, qc double, qn double, tj double, tc double, tn double, damp double, rss double, " + ", ".join(f"g{p} double" for p in "jcn") + ", " + ", ".join(f"a{p} double" for p in _UPPER) + ", points long, done boolean"


def brillouin_fit(df: DataFrame, keys: Sequence[str], rules: Mapping[float, Sequence[str]], start: Mapping[str, float], temperature: str = "t", h: str = "h", m: str = "m", d: str = "d", turns: int = 200) -> DataFrame:
    """Fits J, C and n of the model to M(H) per group, varying at each temperature only what `rules` say, from the values of `start`: j, j_err, c, c_err, n, n_err, red_chi2, points.

    Levenberg-Marquardt on parameters scaled by their starts, all groups in step: a turn is one pass over the written rows, in which each row's residual and derivatives become the sums J'J, J'r and r'r of its
    group, added up before they are shuffled, so a group of any size is many tasks' work; then each group takes or refuses its trial, until all have converged. Errors come from the covariance scaled by
    the reduced chi-square; a fixed parameter has error 0. `keys` include the temperature; rows with a missing field, magnetization or factor are left out.
    """
    names, size = ("j", "c", "n"), {p: start[p] or 1.0 for p in ("j", "c", "n")}
    held = [k for k in keys if k not in (temperature,)]
    own = [*held, temperature]
    rows = written(df.where(F.col(h).isNotNull() & F.col(m).isNotNull() & F.col(d).isNotNull() & F.col(temperature).isNotNull()).select(*held, F.col(temperature), F.col(h).cast("double").alias("__h"), F.col(m).cast("double").alias("__m"), F.col(d).cast("double").alias("__d")), "points")
    column = lambda b, c: b.column(c).to_numpy(zero_copy_only=False).astype(float)

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, dd, t = (column(b, c) for c in ("__h", "__m", "__d", temperature))
            q = {p: column(b, f"t{p}") for p in names}
            rest = lambda moved=None, by=0.0: _model(x, y, dd, t, *((q[p] + (by if p == moved else 0.0)) * size[p] for p in names)) - y  # noqa: E731, B023
            r, slope = rest(), {p: (rest(p, 1e-6) - rest(p, -1e-6)) / 2e-6 for p in names}
            out = [r * r, *(slope[p] * r for p in names), *(slope[u[0]] * slope[u[1]] for u in _UPPER)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in own), *(pa.array(c) for c in out)], names=[*own, "s_rss", *(f"s_g{p}" for p in names), *(f"s_a{u}" for u in _UPPER)])

    sums = ["s_rss", *(f"s_g{p}" for p in names), *(f"s_a{u}" for u in _UPPER)]
    summed = T.StructType([*(rows.schema[k] for k in own), *(T.StructField(c, T.DoubleType()) for c in sums)])
    whole = T.StructType([*(rows.schema[k] for k in own), *T.StructType.fromDDL(_STATE).fields])

    def solved(a: np.ndarray, g: np.ndarray, free: np.ndarray, damp: float) -> np.ndarray:
        out = np.zeros(3)
        if free.any():
            some = a[np.ix_(free, free)]
            out[free] = np.linalg.lstsq(some + damp * np.diag(np.maximum(np.diag(some), 1e-30)), -g[free], rcond=None)[0]
        return out

    def matrix(r: dict, of: str) -> np.ndarray:
        a = np.zeros((3, 3))
        for (i, k), u in zip(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), _UPPER, strict=True):
            a[i, k] = a[k, i] = r[f"{of}a{u}"]
        return a

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes or refuses each group's trial, and makes the next one."""
        for b in batches:
            out = []
            for r in b.to_pylist():
                free = np.array([p in rules.get(float(r[temperature]), names) for p in names])
                first, better = r["rss"] is None, r["rss"] is None or r["s_rss"] < r["rss"]
                new = {k: r[k] for k in own}
                if better:
                    new |= {f"q{p}": r[f"t{p}"] for p in names} | {"rss": r["s_rss"]} | {f"g{p}": r[f"s_g{p}"] for p in names} | {f"a{u}": r[f"s_a{u}"] for u in _UPPER}
                    damp = 1e-3 if first else max(r["damp"] / 5, 1e-12)
                    done = not free.any() or r["s_rss"] == 0 or (not first and r["rss"] - r["s_rss"] <= 1e-14 * r["rss"])
                else:
                    new |= {c: r[c] for c in ("qj", "qc", "qn", "rss", *(f"g{p}" for p in names), *(f"a{u}" for u in _UPPER))}
                    damp = r["damp"] * 4
                    done = damp > 1e12
                step = solved(matrix(new, ""), np.array([new[f"g{p}"] for p in names]), free, damp)
                done = done or all(abs(x) <= 1e-12 * abs(new[f"q{p}"]) for p, x in zip(names, step, strict=True))  # a step too small to tell
                new |= {f"t{p}": new[f"q{p}"] + float(x) for p, x in zip(names, step, strict=True)} | {"damp": damp, "points": r["n_rows"], "done": bool(done)}
                out.append(new)
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(whole))

    begin = {p: start[p] / size[p] for p in names}
    groups = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("points"))
    state = groups.select(*own, *(F.lit(begin[p]).alias(f"q{p}") for p in names), *(F.lit(begin[p]).alias(f"t{p}") for p in names), F.lit(None).cast("double").alias("damp"), F.lit(None).cast("double").alias("rss"), *(F.lit(None).cast("double").alias(x) for x in (*(f"g{p}" for p in names), *(f"a{u}" for u in _UPPER))), "points", F.lit(False).alias("done"))
    state = written(state, "fit")
    few = state.count() <= FEW
    same = lambda: [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(own)]
    finished = state.where("done")
    for _ in range(turns):
        open_ = state.where("NOT done")
        if open_.isEmpty():
            break
        trial = open_.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(own)), "tj", "tc", "tn")
        given = rows.join(F.broadcast(trial) if few else trial, same()).select(*rows.columns, "tj", "tc", "tn")
        told = given.mapInArrow(derive, summed).groupBy(*own).agg(*(F.sum(c).alias(c) for c in sums))
        told = told.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(own)), *sums)
        tried = open_.join(told, same()).select(*open_.columns, *sums).withColumn("n_rows", F.col("points"))
        after = written(tried.mapInArrow(decide, whole), "fit")
        finished, state = finished.unionByName(after.where("done")), after
    out = _fields(df, keys, "j double, j_err double, c double, c_err double, n double, n_err double, red_chi2 double, points long")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for r in b.to_pylist():
                free = np.array([p in rules.get(float(r[temperature]), names) for p in names])
                chi2 = r["rss"] / max(1, r["points"] - int(free.sum()))
                error = np.zeros(3)
                if free.any():
                    error[free] = np.sqrt(np.maximum(np.diag(np.linalg.pinv(matrix(r, "")[np.ix_(free, free)])) * chi2, 0))
                row = {k: r[k] for k in keys} | {"red_chi2": chi2, "points": r["points"]}
                for p, e in zip(names, error, strict=True):
                    row |= {p: r[f"q{p}"] * size[p], f"{p}_err": float(e) * abs(size[p])}
                done.append(row)
            yield pa.RecordBatch.from_pylist(done, schema=to_arrow_schema(out))

    return finished.unionByName(state.where("NOT done")).mapInArrow(tell, out)


def saturation(df: DataFrame) -> DataFrame:
    """Adds m0 = n g(J) mu_B J and its error from independent errors of J and n (a missing error counts as 0)."""
    j, n = F.col("j"), F.col("n")
    # g J = 3J/2 + (1 - J^2) / (2 (J + 1)) = J + 1/2 for J > 0, so its derivative is 1
    m0 = n * lande_g("j") * MU_B * j
    err = MU_B * F.hypot(lande_g("j") * j * F.coalesce("n_err", F.lit(0.0)), n * F.coalesce("j_err", F.lit(0.0)))
    return df.withColumns({"m0": m0, "m0_err": err})


def extrapolate(params: DataFrame, h_max: float = 90_000.0, points: int = 10) -> DataFrame:
    """Solves the model on a grid of fields for each row of parameters, at their values and at values plus and minus their errors: h, m, m_max, m_min, m_err."""
    grid = params.withColumn("h", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k * (h_max / (points - 1)))))
    for name, sign in (("m", 0), ("m_max", 1), ("m_min", -1)):
        grid = grid.withColumns({f"__{p}": F.col(p) + sign * F.coalesce(f"{p}_err", F.lit(0.0)) for p in ("j", "c", "n")})
        grid = solve_magnetization(grid, "h", "d", "t", "__j", "__c", "__n", name)
    out = grid.drop("__j", "__c", "__n")
    return out.withColumn("m_err", F.greatest(F.abs(F.col("m") - F.col("m_min")), F.abs(F.col("m") - F.col("m_max")))).withColumn("b", flux_density("h", "m", "d"))


def majumdar_fit(df: DataFrame, keys: Sequence[str], rho: str = "rho", m: str = "m", m0: str = "m0") -> DataFrame:
    """Per group rho0 (the largest resistivity) and a >= 0 of rho = rho0 (1 - a (M/M0)^2), in closed form by sums."""
    u = F.pow(F.col(m) / F.col(m0), 2)
    sums = df.groupBy(*keys).agg(F.max(rho).alias("rho0"), F.sum(u).alias("su"), F.sum(u * F.col(rho)).alias("sur"), F.sum(u * u).alias("suu"))
    a = F.try_divide(F.col("su") - F.col("sur") / F.col("rho0"), F.col("suu"))
    return sums.select(*keys, "rho0", F.greatest(F.lit(0.0), a).alias("a"))


def linear_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and r2 of y on x per group."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def ratio_check(df: DataFrame, fitted: str, measured: str, name: str = "ratio") -> DataFrame:
    """Fitted over measured value; missing where the measured one is zero."""
    return df.withColumn(name, F.try_divide(F.col(fitted), F.col(measured)))
