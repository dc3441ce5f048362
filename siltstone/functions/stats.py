"""Small statistics on numbers that an aggregation has already made few."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from statistics import median, stdev


def round2(x: float | None, digits: int = 2) -> float | None:
    """Half away from zero on the exact binary value."""
    return None if x is None else float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def nearest(x: float) -> int:
    """The nearest whole number, halves up."""
    return math.floor(x + 0.5)


def percent_change(before: float, after: float) -> float | None:
    return None if before == 0 else (after - before) / abs(before) * 100


def trend(values: list[float]) -> tuple[float, float]:
    """Slope and r squared of a least-squares line over the places; a flat series has 0 for both."""
    n = len(values)
    if n < 2:
        return 0.0, 0.0
    mx, my = (n - 1) / 2, sum(values) / n
    sxx = sum((i - mx) ** 2 for i in range(n))
    syy = sum((v - my) ** 2 for v in values)
    sxy = sum((i - mx) * (v - my) for i, v in enumerate(values))
    return sxy / sxx, (sxy * sxy / (sxx * syy) if syy else 0.0)


def robust_scale(values: list[float]) -> float:
    """Median absolute deviation; the median size if that is 0, then the deviation from the mean."""
    mid = median(values)
    return median(abs(v - mid) for v in values) or median(map(abs, values)) or (stdev(values) if len(values) > 1 else 0.0)


def chi2_tail(x: float, degrees: int) -> float:
    """Probability that a chi-squared value of so many degrees of freedom is over ``x``."""
    if x <= 0 or degrees <= 0:
        return 1.0
    a, y = degrees / 2, x / 2
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:  # series of the lower part
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - front * total)
    # continued fraction of the upper part, evaluated from below
    fraction = 0.0
    for k in range(500, 0, -1):
        fraction = k * (k - a) / (y + 2 * k + 1 - a - fraction)
    return min(1.0, front / (y + 1 - a - fraction))


def cramers_v(chi2: float, n: int) -> float:
    """For a table with two columns."""
    return math.sqrt(chi2 / n) if n else 0.0


def compact(x: float) -> str:
    """A number for reading: 1.2M, 3.4K, 12, 0.53."""
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(x) >= size:
            return f"{round2(x / size, 1):g}{unit}"
    return f"{round2(x):g}"
