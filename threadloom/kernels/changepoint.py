"""Change points of short series: exact optimal partitioning with a Gaussian-kernel cost."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import ship

ship(__name__)


def median_square(x: np.ndarray) -> float:
    """Median squared distance of two values, by counting pairs below a distance: no table of all pairs is made."""
    y, n = np.sort(x), len(x)
    pairs = n * (n - 1) // 2

    def smallest(k: int) -> float:
        """The k-th smallest distance (from 1): the least float that as many pairs don't exceed."""
        low, high = -1.0, float(y[-1] - y[0])
        while True:
            mid = (low + high) / 2 if low >= 0 else 0.0
            if mid in (low, high):
                return high
            if (np.searchsorted(y, y + mid, "right") - np.arange(1, n + 1)).sum() >= k:
                high = mid
            else:
                low = mid
            if high == 0.0:
                return 0.0

    return (smallest((pairs + 1) // 2) ** 2 + smallest(pairs // 2 + 1) ** 2) / 2 if pairs else 0.0


def kernel_row(x: np.ndarray, at: int, width: float) -> np.ndarray:
    """Gaussian kernel of a point with those up to it, exponents within 0.01 to 100, and 1 with itself."""
    row = np.exp(-np.clip((x[: at + 1] - x[at]) ** 2 / width, 1e-2, 1e2))
    row[-1] = 1.0
    return row


def gram(series) -> np.ndarray:
    """Kernel of all pairs: the table whose rows ``change_points`` takes one by one, for short series."""
    x = np.asarray(series, float)
    width, out = median_square(x) or 1.0, np.empty((len(x), len(x)))
    for at in range(len(x)):
        out[at, : at + 1] = out[: at + 1, at] = kernel_row(x, at, width)
    return out


#: How much less two segments may cost together than one of both, for each point of the first: the clip of exponents at 0.01
#: takes at most 1 - exp(-0.01) from a pair, so it takes no more than twice that from the kernel's gain (without it, no less than 0).
SLACK = 0.02


def change_points(series, penalty: float = 3.0, least: int = 2) -> list[int]:
    """Last index of each segment but the final one; none for series shorter than four.

    The total cost of segments plus ``penalty`` for each is minimized exactly over all
    segmentations with ``least`` points or more in a segment. A segment's cost is its
    length less its mean kernel row; the kernel's width is from the median squared distance.
    Rows of the kernel are made one by one, so memory is linear in the series.

    Starts that can't be best again are dropped: one whose segment up to a point costs more than the
    best segmentation up to there does, by ``SLACK`` for each of the segment's points. Time
    is the sum of what is left, which changes of level keep short; without any it is quadratic.
    """
    x = np.asarray(series, float)
    n = len(x)
    if n < 4:
        return []
    width = median_square(x) or 1.0
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    start = np.arange(n)  # the starts that are left, ascending: the first ``used``
    inner = np.zeros(n)  # for each of them, the kernel's sum over the segment up to here
    used, drops = 0, []
    for end in range(1, n + 1):
        while drops and drops[0][0] <= end:
            gone = np.isin(start[:used], drops.pop(0)[1])
            keep = np.flatnonzero(~gone)
            start[: len(keep)], inner[: len(keep)], used = start[keep], inner[keep], len(keep)
        start[used], inner[used], used = end - 1, 0.0, used + 1
        low = int(start[0])
        row = kernel_row(x[low:end], end - 1 - low, width)
        inner[:used] += 2 * row[::-1].cumsum()[::-1][start[:used] - low] - 1
        if end < least:
            continue
        m = int(np.searchsorted(start[:used], end - least, "right"))
        s = start[:m]
        total = best[s] + (end - s) - inner[:m] / (end - s) + penalty
        k = int(np.argmin(total))
        best[end], back[end] = total[k], s[k]
        # A cut at this end can follow ``least`` points later only, so starts are dropped from then on.
        over = total - penalty - SLACK * (end - s) > best[end]
        if over.any() and (end % 16 == 0):
            drops.append((end + least, s[over].copy()))
    cuts, at = [], n
    while at > 0:
        at = int(back[at])
        if at:
            cuts.append(at - 1)
    return cuts[::-1]


def column(penalty: float = 3.0):
    """A column function from an array of doubles to an array of positions."""

    @F.pandas_udf("array<int>")
    def found(series: pd.Series) -> pd.Series:
        return pd.Series([change_points(s, penalty) for s in series])

    return found
