"""Distribution functions as column expressions: log-gamma, regularised incomplete beta, complementary error function.

They are built from Spark's own functions, so p values stay inside the plan. Accuracy is about 1e-12 for the
arguments that tests of correlations and shares have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the asymptotic series of log-gamma: B(2k) / (2k (2k - 1)). Fixed values.
SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def log_gamma(z: Column, shift: int = 12) -> Column:
    """ln Gamma(z) for z > 0: the asymptotic series at z + shift, less the logarithms of the factors between."""
    x = z + shift
    series = sum((F.lit(c) / F.pow(x, F.lit(float(2 * k + 1))) for k, c in enumerate(SERIES)), F.lit(0.0))
    between = F.aggregate(F.sequence(F.lit(0), F.lit(shift - 1)), F.lit(0.0), lambda s, k: s + F.ln(z + k))
    return (x - 0.5) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + series - between


def _fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = 1 / safe(1 - (a + b) * x / (a + 1))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def step(s: Column, m: Column) -> Column:
        k = m.cast("double")
        one = k * (b - k) * x / ((a - 1 + 2 * k) * (a + 2 * k))
        d, c = 1 / safe(1 + one * s["d"]), safe(1 + one / s["c"])
        h = s["h"] * d * c
        two = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 1 + 2 * k))
        d, c = 1 / safe(1 + two * d), safe(1 + two / c)
        return state(c, d, h * d * c)

    return F.aggregate(F.sequence(F.lit(1), steps), state(F.lit(1.0), d0, d0), step)["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for a, b > 0 and x in 0..1. The number of steps grows with the square root of a and b."""
    a, b, x = a.cast("double"), b.cast("double"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    steps = (40 + 4 * F.sqrt(F.greatest(a, b))).cast("int")
    below = x < (a + 1) / (a + b + 2)
    lower, upper = front * _fraction(a, b, x, steps) / a, 1 - front * _fraction(b, a, 1 - x, steps) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(below, lower).otherwise(upper)


def erfc(x: Column) -> Column:
    """Complementary error function: a series up to 2.5, a continued fraction beyond."""
    z = F.abs(x)
    term = lambda s, k: F.struct((s["t"] * -z * z / k).alias("t"), (s["s"] + s["t"] * -z * z / k / (2 * k + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), term)["s"]
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda s, k: z + k / F.lit(2.0) / s)
    up = F.when(z < 2.5, 1 - F.lit(2 / math.sqrt(math.pi)) * series).otherwise(F.exp(-z * z) / tail / F.lit(math.sqrt(math.pi)))
    return F.when(x < 0, 2 - up).otherwise(up)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p value of a correlation of n pairs (Pearson's, or a rank correlation's by the same t): NULL below 3 pairs, 0 at -1 and 1."""
    return F.when(n >= 3, incomplete_beta((n - 2) / 2.0, F.lit(0.5), 1 - r * r))


def share_p(hits: Column, n: Column) -> Column:
    """Two-sided p value of `hits` of n against a half, by the normal approximation; NULL without any."""
    return F.when(n > 0, erfc(F.abs((hits - n / 2) / F.sqrt(n / 4)) / F.lit(math.sqrt(2))))
