"""Tail probabilities that Spark has no built-in for: normal, Student's t and chi-square as columns; plain functions beside them for single values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorized import vectorized


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + up * d) or tiny)
            c = (1 + up / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    if not (df > 0) or t != t:
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail: series below the mean, continued fraction above."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation over n pairs, by Student's t."""
    if n < 3 or r != r:
        return math.nan
    return 0.0 if abs(r) >= 1 else student_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


# The polynomials of Royston (1995) for the two outer weights of Shapiro-Wilk.
OUTER, NEXT = (0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)


def shapiro_w(n: int, mm: float, mx: float, spread: float, last_score: float, next_score: float, outer_gap: float, inner_gap: float) -> float:
    """W from sums over the sorted values and their normal scores; weights are antisymmetric, so that outer values count by their gaps."""
    if n == 3:
        return min(1.0, outer_gap**2 / 2 / spread)
    u = n**-0.5
    last = last_score / math.sqrt(mm) + sum(c * u**k for k, c in enumerate(OUTER))
    if n <= 5:
        phi = (mm - 2 * last_score**2) / (1 - 2 * last**2)
        top = (mx - last_score * outer_gap) / math.sqrt(phi) + last * outer_gap
    else:
        second = next_score / math.sqrt(mm) + sum(c * u**k for k, c in enumerate(NEXT))
        phi = (mm - 2 * last_score**2 - 2 * next_score**2) / (1 - 2 * last**2 - 2 * second**2)
        top = (mx - last_score * outer_gap - next_score * inner_gap) / math.sqrt(phi) + last * outer_gap + second * inner_gap
    return min(1.0, top**2 / spread)


def shapiro_p(w: float, n: int) -> float:
    """p of W, by the same author's transformations; beyond 5000 values they are carried on."""
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if math.log(1 - w) >= gamma:
            return 0.0
        y = -math.log(gamma - math.log(1 - w))
        mean, sd = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 6.714e-4 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        k, y = math.log(n), math.log(1 - w)
        mean, sd = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3, math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


def shapiro_from_sums(n, mm, mx, spread, last_score, next_score, outer_gap, inner_gap) -> float | None:
    """p of three values or more with any spread; else None."""
    if n < 3 or not spread > 0:
        return None
    n = int(n)
    return shapiro_p(shapiro_w(n, mm, mx, spread, last_score, next_score, outer_gap, inner_gap), n)


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties, from the counts of all arrangements."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1
    for i in range(1, n1 + 1):  # Gaussian binomial: times (1 - q^(n2+i)) over (1 - q^i)
        step = n2 + i
        counts[step:] -= counts[:-step].copy() if step <= n1 * n2 else 0
        for k in range(i, len(counts)):
            counts[k] += counts[k - i]
    low = min(u, n1 * n2 - u)
    return min(1.0, 2 * counts[: int(math.floor(low)) + 1].sum() / counts.sum())


def let(value: Column, fn) -> Column:
    """``fn`` of a column that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _known(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value), value)


# The rational approximations of the error function by Cody (1969), below 0.46875, up to 4 and beyond.
ERF = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_UNDER = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERFC = (
    5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03,
    2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8,
)
ERFC_UNDER = (
    1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
    3.43936767414372164e03, 1.23033935480374942e03,
)
FAR = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
FAR_UNDER = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _rational(x: Column, over: tuple[float, ...], under: tuple[float, ...]) -> Column:
    """A ratio of polynomials; the leading factor of ``over`` stands last, that of ``under`` is 1."""
    up, down = over[-1] * x, x
    for a, b in zip(over[:-2], under[:-1]):
        up, down = (up + a) * x, (down + b) * x
    return (up + over[-2]) / (down + under[-1])


def erfc(x: Column) -> Column:
    """Complement of the error function for x >= 0."""
    # in two factors, as the square loses digits
    rough = lambda v: F.floor(v * 16) / 16
    decay = lambda v: F.exp(-rough(v) * rough(v)) * F.exp(-(v - rough(v)) * (v + rough(v)))
    beyond = lambda v: (1 / math.sqrt(math.pi) - let(1 / (v * v), lambda z: z * _rational(z, FAR, FAR_UNDER))) / v
    near = lambda v: 1 - v * let(v * v, lambda z: _rational(z, ERF, ERF_UNDER))
    return let(x, lambda v: F.when(v <= 0.46875, near(v)).when(v <= 4, decay(v) * _rational(v, ERFC, ERFC_UNDER)).when(v < 27, decay(v) * beyond(v)).otherwise(F.when(v.isNotNull(), 0.0)))


def normal_p_value(z) -> Column:
    """Two-sided p of a normal z; null for null and NaN."""
    return erfc(_known(F.abs(_column(z))) / math.sqrt(2))


def chi_square_p(x, df) -> Column:
    """Upper tail of chi-square with a whole number of degrees: a finite sum of positive terms, in logarithms, and erfc where that is odd."""

    def tail(v: Column) -> Column:
        h, n = v["x"] / 2, v["df"]
        odd = F.pmod(n, F.lit(2)) == 1
        first = F.when(odd, -h + F.log(h) / 2 - math.log(math.sqrt(math.pi) / 2)).otherwise(-h)
        half = F.when(odd, 0.5).otherwise(0.0)
        terms = F.when(n >= 2, F.sequence(F.lit(1), F.floor(n / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(0.0).alias("total"), first.alias("log"))
        step = lambda s, k: F.struct((s["total"] + F.exp(s["log"])).alias("total"), (s["log"] + F.log(h) - F.log(k + half)).alias("log"))
        return F.when(h <= 0, 1.0).otherwise(F.aggregate(terms, start, step, lambda s: s["total"]) + F.when(odd, erfc(F.sqrt(h))).otherwise(0.0))

    known = _known(_column(x).cast("double")).isNotNull() & (_column(df) >= 1)
    return F.when(known, let(F.struct(_column(x).cast("double").alias("x"), _column(df).cast("double").alias("df")), tail))


# The expansion of gamma(a + 1/2) / gamma(a) / sqrt(a) in powers of 1 / a.
HALF_STEP = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)


def _half_step(a: Column, shift: int = 40) -> Column:
    """gamma(a + 1/2) / gamma(a), from far enough out for the expansion."""
    near = F.aggregate(F.sequence(F.lit(0), F.lit(shift - 1)), F.lit(1.0), lambda s, k: s * (a + k) / (a + k + 0.5))
    out = F.lit(0.0)
    for c in reversed(HALF_STEP):
        out = out / (a + shift) + c
    return near * F.sqrt(a + shift) * out


def _fraction(a: Column, b: Column, x: Column, turns: int = 64) -> Column:
    """Continued fraction of the incomplete beta function from the front; 48 turns are the most that any degrees need."""
    tiny = lambda v: F.when(v == 0, 1e-300).otherwise(v)
    start = let(1 / tiny(1 - (a + b) * x / (a + 1)), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("out")))

    def half(s: Column, up: Column) -> Column:
        c, d = tiny(1 + up / s["c"]), 1 / tiny(1 + up * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["out"] * c * d).alias("out"))

    def turn(s: Column, m: Column) -> Column:
        first = half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return let(first, lambda t: half(t, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(turns)), lambda k: k.cast("double")), start, turn, lambda s: s["out"])


def student_p_value(t, df) -> Column:
    """Two-sided p of Student's t; null for null and NaN, or without degrees."""

    def tail(v: Column) -> Column:
        a, half, square = v["df"] / 2, F.lit(0.5), v["t"] * v["t"]
        # x is df / (df + t^2), y what is left of 1; both keep their digits where the other is near 1
        x, y = v["df"] / (v["df"] + square), square / (v["df"] + square)
        front = _half_step(a) / math.sqrt(math.pi) * F.exp(-a * F.log1p(square / v["df"])) * F.sqrt(y)
        return F.when(square == 0, 1.0).when(x < (a + 1) / (a + 2.5), front * _fraction(a, half, x) / a).otherwise(1 - front * _fraction(half, a, y) / 0.5)

    t, df = _column(t).cast("double"), _column(df).cast("double")
    known = _known(t).isNotNull() & (df > 0)
    return F.when(known & (F.abs(t) == float("inf")), 0.0).when(known, let(F.struct(t.alias("t"), df.alias("df")), tail))


def correlation_p_value(r, n) -> Column:
    """Two-sided p of a correlation over n pairs, by Student's t; null below three pairs."""
    r, n = _known(_column(r).cast("double")), _column(n).cast("double")
    return F.when(r.isNotNull() & (n >= 3), F.when(F.abs(r) >= 1, 0.0).otherwise(student_p_value(r * F.sqrt((n - 2) / (1 - r * r)), n - 2)))


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _each(fn, *series: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*series)], dtype="float64")


@vectorized("double")
def shapiro_p_value(n: pd.Series, mm: pd.Series, mx: pd.Series, spread: pd.Series, last_score: pd.Series, next_score: pd.Series, outer_gap: pd.Series, inner_gap: pd.Series) -> pd.Series:
    return _each(shapiro_from_sums, n, mm, mx, spread, last_score, next_score, outer_gap, inner_gap)
