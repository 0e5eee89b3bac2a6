"""Least squares from grouped second moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def moments(y: str, features: Sequence[str]) -> list[Column]:
    """Aggregates that determine an affine fit of ``y`` on up to three features."""
    names = [y, *features]
    out = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)]
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i <= j:
                out.append((F.var_pop(a) if i == j else F.covar_pop(a, b)).alias(f"_v{i}{j}"))
    return out


def _determinant(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    total = None
    for j, head in enumerate(m[0]):
        minor = [row[:j] + row[j + 1 :] for row in m[1:]]
        term = head * _determinant(minor)
        total = term if total is None else (total - term if j % 2 else total + term)
    return total


def coefficients(k: int) -> dict[str, Column]:
    """``b1..bk`` and the intercept ``b0`` from the columns ``moments`` produced.

    A singular system (constant or collinear features) yields NULL.
    """
    s = [[F.col(f"_v{min(i, j)}{max(i, j)}") for j in range(1, k + 1)] for i in range(1, k + 1)]
    r = [F.col(f"_v0{i}") for i in range(1, k + 1)]
    det = F.nullif(_determinant(s), F.lit(0.0))
    slopes = []
    for c in range(k):
        replaced = [[r[i] if j == c else s[i][j] for j in range(k)] for i in range(k)]
        slopes.append(_determinant(replaced) / det)
    intercept = F.col("_m0")
    for c, b in enumerate(slopes):
        intercept = intercept - b * F.col(f"_m{c + 1}")
    return {"b0": intercept, **{f"b{c + 1}": b for c, b in enumerate(slopes)}}
