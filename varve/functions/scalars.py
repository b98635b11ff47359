"""Column expressions: the normal distribution, labels, and interpolation on a curve of a few points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, within 1e-7: erf by the rational approximation 7.1.26 of Abramowitz and
    Stegun, whose constants follow."""
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    half = poly * F.exp(-z * z) / 2
    return F.when(x < 0, half).otherwise(1 - half)


def percent_label(prefix: str, share: Column) -> Column:
    """Labels such as p05 and p99 for quantile levels."""
    return F.concat(F.lit(prefix), F.lpad(F.round(share * 100).cast("int").cast("string"), 2, "0"))


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation on a curve of ascending points; beyond its ends, the end's value."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, u), (b, v) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, u + (x - a) * ((v - u) / (b - a)))
    return out.otherwise(F.lit(points[-1][1]))


#: Acklam's rational approximation of the normal quantile (numerators and denominators, centre and tails).
_CENTRE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, within 1.2e-9 relatively; null outside (0, 1)."""

    def poly(cs: tuple[float, ...], x: Column) -> Column:
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * x + c
        return out

    q = p - 0.5
    r = q * q
    tail = lambda u: poly(_TAIL[0], F.sqrt(-2 * F.ln(u))) / poly(_TAIL[1], F.sqrt(-2 * F.ln(u)))
    inside = F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(q * poly(_CENTRE[0], r) / poly(_CENTRE[1], r))
    return F.when((p > 0) & (p < 1), inside)
