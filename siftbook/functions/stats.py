"""Distribution functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the published coefficients of Lanczos' approximation for g = 7 and nine terms
_LANCZOS_G = 7.0
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
STEPS = 20_000
CLOSE = 1e-15
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 0.5."""
    z = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + _LANCZOS_G + 0.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function; two terms a step, no more steps once it stands still."""

    def away(c: Column) -> Column:
        return F.when(F.abs(c) < TINY, F.lit(TINY)).otherwise(c)

    def term(s: Column, factor: Column) -> tuple[Column, Column]:
        return F.lit(1.0) / away(1 + factor * s["d"]), away(1 + factor / s["c"])

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = term(s, even)
        half = F.struct(d1.alias("d"), c1.alias("c"), (s["h"] * d1 * c1).alias("h"))
        whole = F.get(F.transform(F.array(half), lambda t: _second(t, odd, term)), 0)
        return F.when(s["done"], s).otherwise(whole)

    first = F.lit(1.0) / away(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"), F.lit(False).alias("done"))
    # the number of steps that is needed grows with the square root of the parameters
    steps = F.least(F.lit(STEPS), (F.lit(60) + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["h"])


def _second(t: Column, factor: Column, term) -> Column:
    d, c = term(t, factor)
    return F.struct(d.alias("d"), c.alias("c"), (t["h"] * d * c).alias("h"), (F.abs(d * c - 1) < CLOSE).alias("done"))


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function for a, b >= 0.5 and x between 0 and 1."""
    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    inside = F.when(x < (a + 1) / (a + b + 2), front * _fraction(x, a, b) / a).otherwise(1 - front * _fraction(1 - x, b, a) / b)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null without degrees of freedom."""
    df = df.cast("double")
    return F.when(df > 0, incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5)))


def sign_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p-value of ``b`` against ``c`` changes at even odds; 1 if there are none."""
    low, n = F.least(b, c), b + c
    return F.when(n > 0, F.when(b == c, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * incomplete_beta(F.lit(0.5), (n - low).cast("double"), (low + 1).cast("double"))))).otherwise(1.0)
