"""Column expressions: dates, units, identifiers, encodings, and the formulas of the measurement tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Constants in CGS units.
MU_B = 9.2740100783e-21  # erg/G
K_B = 1.380649e-16  # erg/K
AVOGADRO = 6.0221408e23  # 1/mol
EMU_IN_MU_B = 1.078e20


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def date_parts(df: DataFrame, col: str) -> DataFrame:
    """Adds year, month and day of a date or of a text that is one."""
    d = F.to_date(col)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)})


def log_col(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Natural logarithm; of zero and below it is missing."""
    return df.withColumn(name or f"log_{col}", F.when(F.col(col) > 0, F.ln(col)))


def degrees_to_radians(x) -> Column:
    return F.radians(_c(x))


def micro(x) -> Column:
    return _c(x) * 1e6


def oersted_to_tesla(x) -> Column:
    return _c(x) / 10000


def per_volume(moment, volume) -> Column:
    return F.try_divide(_c(moment), _c(volume))


def per_gram(moment, mass) -> Column:
    return F.try_divide(_c(moment), _c(mass))


def per_mole(moment, mass, molar_mass) -> Column:
    return per_gram(moment, mass) * _c(molar_mass)


def bohr_magnetons(emu_per_mole) -> Column:
    """Bohr magnetons per formula unit."""
    return _c(emu_per_mole) / AVOGADRO * EMU_IN_MU_B


def with_units(df: DataFrame, moment: str, field: str, mass: float, molar_mass: float, volume: float) -> DataFrame:
    """Adds the field in tesla and the magnetization per volume, gram, mole and formula unit."""
    return df.withColumns({"h_t": oersted_to_tesla(field), "m_emu_cm3": per_volume(moment, volume), "m_emu_g": per_gram(moment, mass), "m_emu_mol": per_mole(moment, mass, molar_mass), "m_mu_b": bohr_magnetons(per_mole(moment, mass, molar_mass))})


def micro_ohm_columns(df: DataFrame) -> DataFrame:
    """A micro-unit copy of each column in ohm; percent columns are left alone."""
    return df.withColumns({c.replace("ohm", "uohm"): F.col(c) * 1e6 for c in df.columns if "ohm" in c and "uohm" not in c})


def flux_density(h, m, d) -> Column:
    """B = H + 4 pi (1 - D) M."""
    return _c(h) + 4 * math.pi * (1 - _c(d)) * _c(m)


def demag_factor(a, b, c) -> Column:
    """Demagnetizing factor along c of a rectangular prism with half-lengths a, b, c (Aharoni's closed form)."""
    a, b, c = _c(a), _c(b), _c(c)
    ab, bc, ac, abc = F.sqrt(a * a + b * b), F.sqrt(b * b + c * c), F.sqrt(a * a + c * c), F.sqrt(a * a + b * b + c * c)
    logs = (
        (b * b - c * c) / (2 * b * c) * F.ln((abc - a) / (abc + a))
        + (a * a - c * c) / (2 * a * c) * F.ln((abc - b) / (abc + b))
        + b / (2 * c) * F.ln((ab + a) / (ab - a))
        + a / (2 * c) * F.ln((ab + b) / (ab - b))
        + c / (2 * a) * F.ln((bc - b) / (bc + b))
        + c / (2 * b) * F.ln((ac - a) / (ac + a))
    )
    rest = (
        2 * F.atan(a * b / (c * abc))
        + (a**3 + b**3 - 2 * c**3) / (3 * a * b * c)
        + (a * a + b * b - 2 * c * c) / (3 * a * b * c) * abc
        + c / (a * b) * (ac + bc)
        - (ab**3 + bc**3 + ac**3) / (3 * a * b * c)
    )
    return (logs + rest) / math.pi


def oriented_demag(df: DataFrame, angle: str = "deg", geo: str = "geo", length: str = "l", width: str = "w", height: str = "h") -> DataFrame:
    """Adds d, the factor of the orientation: at 0, 180 and 360 degrees of (L, W, H); at 90 and 270 of (H, W, L) for `para` and of (L, H, W) for `perp`."""
    flat = F.col(angle).isin(0, 180, 360)
    turned = F.col(angle).isin(90, 270)
    d = F.when(flat, demag_factor(length, width, height)).when(turned & (F.col(geo) == "para"), demag_factor(height, width, length)).when(turned & (F.col(geo) == "perp"), demag_factor(length, height, width))
    return df.withColumn("d", d)


def lande_g(j) -> Column:
    """Lande factor with S = 1/2 and L = J - S."""
    j = _c(j)
    return 1.5 + (0.75 - (j - 0.5) * (j + 0.5)) / (2 * j * (j + 1))


def brillouin(x, j) -> Column:
    """Brillouin function, with its limit (J + 1) x / (3 J) near zero."""
    x, j = _c(x), _c(j)
    p, q = (2 * j + 1) / (2 * j), 1 / (2 * j)
    return F.when(F.abs(x) < 1e-4, (j + 1) * x / (3 * j)).otherwise(p / F.tanh(p * x) - q / F.tanh(q * x))


def model_magnetization(h, m, d, t, j, c, n) -> Column:
    """n g mu_B J B_J(g mu_B J B / (k T)) + C H, with B of flux_density."""
    moment = lande_g(j) * MU_B * _c(j)
    return _c(n) * moment * brillouin(moment * flux_density(h, m, d) / (K_B * _c(t)), j) + _c(c) * _c(h)


def sine_model(theta, amps: Sequence[float], freqs: Sequence[float], phases: Sequence[float], mean) -> Column:
    """mean * (1 + sum a sin(f theta + phase))."""
    total = sum((F.lit(float(a)) * F.sin(float(f) * _c(theta) + float(p)) for a, f, p in zip(amps, freqs, phases, strict=True)), F.lit(0.0))
    return _c(mean) * (1 + total)


def positive_phase(p) -> Column:
    """Wraps a phase of (-pi, pi] to [0, 2 pi)."""
    return F.when(_c(p) < 0, _c(p) + 2 * math.pi).otherwise(_c(p))


def geoid_parts(df: DataFrame, col: str = "geoid") -> DataFrame:
    """Adds the parts of a census block identifier as text, so that leading zeros stay."""
    part = lambda a, n: F.substring(F.col(col), a, n)
    return df.withColumns({"state_id": part(1, 2), "county_id": part(3, 3), "tract_id": part(6, 6), "block_grp": part(12, 1), "block_id": part(12, 4)})


def geoid_of(state, county, tract, block) -> Column:
    """A block identifier from its parts, padded with zeros."""
    return F.concat(F.lpad(_c(state).cast("string"), 2, "0"), F.lpad(_c(county).cast("string"), 3, "0"), F.lpad(_c(tract).cast("string"), 6, "0"), F.lpad(_c(block).cast("string"), 4, "0"))


def label_if(df: DataFrame, name: str, condition: Column, yes, no) -> DataFrame:
    return df.withColumn(name, F.when(condition, F.lit(yes)).otherwise(F.lit(no)))


def ordinal_encode(df: DataFrame, col: str, order: Sequence[str], name: str | None = None) -> DataFrame:
    """Place of a value in an ordered list, from 0; missing for others."""
    place = F.array_position(F.array(*(F.lit(v) for v in order)), F.col(col)) - 1
    return df.withColumn(name or col, F.when(place >= 0, place.cast("int")))


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """A 0/1 column for each value of a fixed list, so that every table gets the same columns; the column itself goes."""
    named = {f"{prefix or col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(named).drop(col)
