"""Small NumPy kernels for what Spark SQL has no function for, and the columns that use them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function."""
    return np.vectorize(math.erfc, otypes=[float])(x)


def beta_fraction(a: float, b: float, x: float, rounds: int = 300) -> float:
    """Continued fraction of the incomplete beta function, evaluated from its far end."""
    value = 0.0
    for i in range(rounds, 0, -1):
        m = i // 2
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = term / (1 + value)
    return 1 / (1 + value)


def regularised_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return scale * beta_fraction(a, b, x) / a
    return 1 - scale * beta_fraction(b, a, 1 - x) / b


def t_p(rho: float, n: float) -> float | None:
    """Two-sided p of a correlation over n rows by its t statistic."""
    if rho is None or rho != rho or n < 3:
        return None
    return 0.0 if abs(rho) >= 1 else regularised_beta((n - 2) / 2, 0.5, 1 - rho * rho)


def _column(function, *columns: Column) -> Column:
    return F.pandas_udf(function, "double")(*columns)


def t_two_sided_p(rho: Column, n: Column) -> Column:
    def p(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([t_p(a, b) for a, b in zip(r, k, strict=True)], dtype=float)

    return _column(p, rho, n)


def chi_square_p(chi2: Column) -> Column:
    """Upper tail with one degree of freedom."""

    def p(x: pd.Series) -> pd.Series:
        return pd.Series(erfc(np.sqrt(x.to_numpy(float) / 2)))

    return F.when(chi2.isNotNull(), _column(p, chi2))


def normal_two_sided_p(z: Column) -> Column:
    def p(x: pd.Series) -> pd.Series:
        return pd.Series(erfc(np.abs(x.to_numpy(float)) / math.sqrt(2)))

    return F.when(z.isNotNull(), _column(p, z))


# -- hash draws -----------------------------------------------------------------------------------

_PRIME = (1 << 31) - 1
#: Cumulative probabilities of a Poisson variable with mean 1.
POISSON_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def hash_draws(seed: int, replicates: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Uniform draws (replicates, items) that depend on seed, replicate and item alone, so on no partitioning.

    Quadratic steps modulo 2**31 - 1; item keys are reduced to below it.
    """
    r, i = replicates.astype(np.int64)[:, None], items.astype(np.int64)[None, :] % _PRIME
    x = (i * 48271 + r * 69621 + seed * 16807 + 12345) % _PRIME
    x = (x * x + r * 40692 + i) % _PRIME
    x = (x * x + i * 16807 + r) % _PRIME
    return (x * 48271 + seed) % _PRIME / _PRIME


def hash_draw(seed: int, replicate: Column, item: Column) -> Column:
    """`hash_draws` as a column, for whole numbers `replicate` and `item`."""
    p, r, i = F.lit(_PRIME), replicate.cast("long"), F.pmod(item.cast("long"), F.lit(_PRIME))
    x = F.pmod(i * 48271 + r * 69621 + F.lit(seed * 16807 + 12345), p)
    # each step is used twice, so it is bound by a one-element transform
    square = lambda column, then: F.element_at(F.transform(F.array(column), then), 1)
    x = square(x, lambda v: F.pmod(v * v + r * 40692 + i, p))
    x = square(x, lambda v: F.pmod(v * v + i * 16807 + r, p))
    return F.pmod(x * 48271 + F.lit(seed), p) / F.lit(float(_PRIME))


def poisson_weights(seed: int, replicates: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of a bootstrap: how often each replicate draws each item."""
    return np.searchsorted(POISSON_STEPS, hash_draws(seed, replicates, items), side="right").astype(np.float64)
