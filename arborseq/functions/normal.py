"""Draws of truncated normals over whole Arrow batches, to double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of published rational approximations, highest power first: the tail (Hart), and the quantile (Acklam).
TAIL_OVER = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
TAIL_UNDER = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
FAR, FARTHEST = 7.07106781186547, 37.0
MIDDLE_OVER = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239]
MIDDLE_UNDER = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0]
OUTER_OVER = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
OUTER_UNDER = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661742562, 1.0]
OUTER = 0.02425
ROOT = math.sqrt(2 * math.pi)


def polynomial(c: Sequence[float], x: np.ndarray) -> np.ndarray:
    return reduce(lambda s, v: s * x + v, c[1:], c[0])


def cdf(z: np.ndarray) -> np.ndarray:
    a = np.abs(z)
    below = np.exp(-a * a / 2)
    chain = reduce(lambda s, k: a + k / s, (4, 3, 2, 1), a + 0.65)
    tail = np.where(a < FAR, below * polynomial(TAIL_OVER, a) / polynomial(TAIL_UNDER, a), np.where(a <= FARTHEST, below / chain / ROOT, 0.0))
    return np.where(z > 0, 1 - tail, tail)


def _rough_quantile(p: np.ndarray) -> np.ndarray:
    r = np.sqrt(-2 * np.log(np.where(p < OUTER, p, 1 - p)))
    outer = polynomial(OUTER_OVER, r) / polynomial(OUTER_UNDER, r)
    m = p - 0.5
    middle = m * polynomial(MIDDLE_OVER, m * m) / polynomial(MIDDLE_UNDER, m * m)
    return np.where(p < OUTER, outer, np.where(p > 1 - OUTER, -outer, middle))


def quantiles(mu: np.ndarray, sigma: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Draws of normal distributions cut to [0, 1], by the inverse of the distribution; NaN stands for null.

    Without spread, or where hardly any of the distribution lies inside, the mean clamped to [0, 1]; u itself if there
    is no mean.
    """
    with np.errstate(all="ignore"):
        spread = sigma > 0
        low, high = cdf(np.where(spread, -mu / sigma, np.nan)), cdf(np.where(spread, (1 - mu) / sigma, np.nan))
        p = low + u * (high - low)
        drawn = spread & (p > 0) & (p < 1) & (high - low >= 1e-12)
        x = _rough_quantile(p)
        # one step of Halley's method
        r = (cdf(x) - p) * ROOT * np.exp(x * x / 2)
        x = x - r / (1 + x * r / 2)
        return np.where(np.isnan(mu), u, np.clip(np.where(drawn, mu + sigma * x, mu), 0.0, 1.0))


def truncated(draws: Column) -> Column:
    """``quantiles`` of an array of struct(mu, sigma, u)."""
    @F.arrow_udf("array<double>")
    def drawn(rows: pa.Array) -> pa.Array:
        each = rows.flatten()
        out = quantiles(*(each.field(n).to_numpy(zero_copy_only=False) for n in ("mu", "sigma", "u")))
        sizes = np.where(rows.is_null().to_numpy(zero_copy_only=False), 0, rows.value_lengths().fill_null(0).to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(out), mask=rows.is_null())

    return drawn(draws)
