"""Two-sided Student-t p-values as Catalyst expressions."""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of the fraction, and the t * t, or the share of t * t in df + t * t, from which it converges to a double within them.
_LEVELS, _TAIL, _SHARE = 60, 3.0, 0.3
#: Terms of the sum for smaller t, where each is at most 0.3 + 1.5 / k times the one before it.
_TERMS = 40
#: The expansion of gamma(z + 1/2) / (gamma(z) * sqrt(z)) in powers of 1 / z, and the shift from which it holds to a double.
_EXPANSION = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)
_SHIFT = 20


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): the expansion at a + 20, brought back by the recurrence."""
    z = a + float(_SHIFT)
    expansion = reduce(lambda acc, c: acc / z + F.lit(c), reversed(_EXPANSION[:-1]), F.lit(_EXPANSION[-1]))
    return F.sqrt(z) * expansion * reduce(mul, [(a + float(k)) / (a + (k + 0.5)) for k in range(_SHIFT)])


def _fraction(a: Column, x: Column, y: Column) -> Column:
    """The continued fraction of I_x(a, 1/2) without its leading factor, y = 1 - x, from the innermost level outwards."""
    b = 0.5
    lead = (a + b) * y - b  # a - (a + b) * x without its cancellation

    def level(n):
        inner = F.when(n > 0, n * (b - n) * x / (a + 2 * n - 1)).otherwise(F.lit(0.0))
        return n + inner + (a + n) / (a + 2 * n + 1) * (lead + 1 + n * (1 + y))

    def outward(below, n):
        up = (a + n - 1) * (a + b + n - 1) / ((a + 2 * n - 1) * (a + 2 * n - 1)) * n * (b - n) * x * x
        return level(n - 1) + up / below

    steps = F.transform(F.sequence(F.lit(_LEVELS), F.lit(1)), lambda n: n.cast("double"))
    return 1.0 / F.aggregate(steps, level(F.lit(float(_LEVELS))), outward)


def _middle(a: Column, y: Column) -> Column:
    """The power series of I_y(1/2, a) without its leading factor."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(_TERMS - 1)), lambda k: k.cast("double"))

    def grown(acc, k):
        term = acc["term"] * (a + 0.5 + k) * y / (k + 1.5)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return 2.0 * F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), grown, lambda acc: acc["sum"])


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for ``df`` degrees of freedom; NULL when undefined.

    The tail is I_x(df / 2, 1/2) at x = df / (df + t * t). In the tail it is computed itself, by a continued
    fraction, and never as a difference from one, so small values keep their digits down to the smallest double; below,
    where it is no small number, its complement is summed. Both cost the same for every ``df``.
    """
    a = F.greatest(df, F.lit(1)).cast("double") / 2.0
    square = (t * t).cast("double")
    x, y = 2.0 * a / (2.0 * a + square), square / (2.0 * a + square)
    # x ** a * sqrt(y) / B(a, 1/2)
    lead = F.exp(-a * F.log1p(square / (2.0 * a))) * F.sqrt(y) * _gamma_ratio(a) / math.sqrt(math.pi)
    p = F.when(F.isnan(t), F.lit(None)).when(square == float("inf"), F.lit(0.0)).when((square >= _TAIL) | (y > _SHARE), lead * _fraction(a, x, y)).otherwise(1.0 - lead * _middle(a, y))
    return F.when(t.isNotNull() & (df >= 1), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
