"""Tail probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: How far the argument of the gamma function is moved up before its asymptotic series is used.
SHIFT = 16
TINY = 1e-300


def log_gamma(a: Column) -> Column:
    """ln of the gamma function for a > 0, by the asymptotic series at a + SHIFT."""
    z = a + SHIFT
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    steps = F.transform(F.sequence(F.lit(0), F.lit(SHIFT - 1)), lambda j: F.log(a + j))
    return series - F.aggregate(steps, F.lit(0.0), lambda t, v: t + v)


def _lower_series(a: Column, x: Column, rounds: Column) -> Column:
    """The sum of x^n / ((a + 1) ... (a + n)) over n >= 0."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(1), rounds), start, step)["total"]


def _upper_fraction(a: Column, x: Column, rounds: Column) -> Column:
    """The continued fraction of the upper tail, from the front (Lentz's method)."""
    guard = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    first = 1 / guard(x + 1 - a)
    start = F.struct(F.lit(1 / TINY).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, n: Column) -> Column:
        above, below = -n * (n - a), x + 1 - a + 2 * n
        c = guard(below + above / s["c"])
        d = 1 / guard(above * s["d"] + below)
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), rounds), start, step)["h"]


def gamma_tail(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x) for a > 0 and x >= 0."""
    a, x = a.cast("double"), x.cast("double")
    rounds = F.ceil(100 + 12 * F.sqrt(a)).cast("int")
    scale = F.exp(a * F.log(F.greatest(x, F.lit(TINY))) - x - log_gamma(a))
    return (
        F.when(x <= 0, 1.0)
        .when(x < a + 1, F.greatest(1 - scale / a * _lower_series(a, x, rounds), F.lit(0.0)))
        .otherwise(scale * _upper_fraction(a, x, rounds))
    )


def chi_square_tail(value: Column, degrees: Column) -> Column:
    """The probability that a chi-square variable with so many degrees of freedom exceeds `value`."""
    return gamma_tail(degrees / 2, value / 2)
