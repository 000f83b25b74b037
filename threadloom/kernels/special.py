"""Tail probabilities and shape tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from . import ship

ship(__name__)


def chi2_tail(x: float, dof: float) -> float:
    """P(chi-square with dof > x): the upper regularized incomplete gamma function."""
    if dof <= 0 or x <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) if a == a and b == b else None for a, b in zip(x, dof, strict=True)])


def _hull(y: np.ndarray, x: np.ndarray, sign: int) -> list[int]:
    """Corners of the greatest convex minorant (sign 1) or least concave majorant (-1) of points.

    Points beyond the line of their neighbours are no corners whatever goes with them, so all
    of them go at once, again and again while this takes an eighth of the points; a stack settles the rest.
    """
    left = np.arange(len(x))
    while len(left) > 64:
        a, b, c = left[:-2], left[1:-1], left[2:]
        beyond = sign * ((y[b] - y[a]) * (x[c] - x[b]) - (y[c] - y[b]) * (x[b] - x[a])) > 0
        if beyond.sum() * 8 < len(left):
            break
        left = left[np.r_[True, ~beyond, True]]
    keep: list[int] = []
    for i in left.tolist():
        while len(keep) > 1 and sign * ((y[keep[-1]] - y[keep[-2]]) * (x[i] - x[keep[-1]]) - (y[i] - y[keep[-1]]) * (x[keep[-1]] - x[keep[-2]])) >= 0:
            keep.pop()
        keep.append(i)
    return keep


def dip(values) -> float:
    """Hartigan's dip: least largest distance of the empirical distribution from a unimodal one.

    For a mode, the distribution below is compared with its greatest convex minorant and
    above with its least concave majorant. The first distance grows with the mode and the
    second falls, so the best of all modes is where they cross, found by bisection.
    """
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 1 / (2 * n) if n else 0.0
    points, counts = np.unique(x, return_counts=True)
    high = np.cumsum(counts) / n
    low = high - counts / n

    def hull(px: np.ndarray, py: np.ndarray, sign: int) -> np.ndarray:
        keep = _hull(py, px, sign)
        return np.interp(px, px[keep], py[keep])

    def sides(m: int) -> tuple[float, float]:
        return np.max(high[: m + 1] - hull(points[: m + 1], low[: m + 1], 1)), np.max(hull(points[m:], high[m:], -1) - low[m:])

    first, last = 0, len(points) - 1
    while first < last:
        m = (first + last) // 2
        below, above = sides(m)
        first, last = (first, m) if below >= above else (m + 1, last)
    return float(min(max(sides(m)) for m in (max(first - 1, 0), first))) / 2


def dip_test(values, draws: int = 100, seed: int = 7) -> tuple[float, float]:
    """The dip and its p-value against uniform samples of the same size."""
    values = np.asarray(values, float)
    rng = np.random.Generator(np.random.PCG64(seed))
    seen = dip(values)
    null = [dip(rng.random(len(values))) for _ in range(draws)]
    return seen, float(np.mean([d >= seen for d in null])) if len(values) >= 4 else 1.0


def separation(values, bins: int = 20, least_height: float = 0.1) -> float:
    """Distance of the two highest peaks of a density histogram over the range; 0 below two peaks."""
    density, edges = np.histogram(values, bins, density=True)
    padded = np.concatenate([[0], density, [0]])
    peaks = [i for i in range(bins) if padded[i + 1] >= least_height and padded[i + 1] > padded[i] and padded[i + 1] >= padded[i + 2]]
    if len(peaks) < 2:
        return 0.0
    a, b = sorted(peaks, key=lambda i: -density[i])[:2]
    return abs(edges[a] - edges[b]) / (edges[-1] - edges[0])


def bimodality_vote(values) -> dict:
    """Votes of dip test, separation and Sarle's coefficient; two or more say bimodal. Below 50 values: insufficient."""
    x = np.asarray([v for v in values if v is not None], float)
    if len(x) < 50 or x.std() == 0:
        return {"verdict": "insufficient", "votes": 0, "dip_p": None, "separation": None, "coefficient": None}
    z = (x - x.mean()) / x.std()
    n, skew, kurt = len(x), float((z**3).mean()), float((z**4).mean() - 3)
    coefficient = (skew**2 + 1) / (kurt + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
    p, sep = dip_test(x)[1], separation(x)
    votes = int(p < 0.05) + int(sep > 0.3) + int(coefficient > 0.555)
    return {"verdict": "bimodal" if votes >= 2 else "unimodal", "votes": votes, "dip_p": p, "separation": sep, "coefficient": coefficient}


@F.pandas_udf(StructType([StructField("verdict", StringType()), StructField("votes", IntegerType()), *(StructField(c, DoubleType()) for c in ("dip_p", "separation", "coefficient"))]))
def vote(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([bimodality_vote(v) for v in values])
