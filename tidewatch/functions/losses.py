"""Grouped error metrics and the modified Diebold-Mariano test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def error_metrics(y_true: Column, y_pred: Column) -> list[Column]:
    """RMSE, MAE, MAPE (percent) and R2 as aggregates; R2 is NULL on a constant truth."""
    e = y_true - y_pred
    floor = F.greatest(F.abs(y_true), F.lit(1e-8))
    spread = F.nullif(F.count(e) * F.var_pop(y_true), F.lit(0.0))
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / floor) * 100).alias("mape"),
        (F.lit(1.0) - F.sum(e * e) / spread).alias("r2"),
    ]


def loss_difference(y: Column, pred_a: Column, pred_b: Column, power: int = 2) -> Column:
    """|e_a|^power - |e_b|^power; positive where A is worse."""
    if power == 2:
        return (y - pred_a) * (y - pred_a) - (y - pred_b) * (y - pred_b)
    return F.pow(F.abs(y - pred_a), F.lit(power)) - F.pow(F.abs(y - pred_b), F.lit(power))


def dm_aggregates(d: str = "d", h: int = 1) -> list[Column]:
    """Moments behind the statistic; for h > 1 lagged copies ``<d>_1..`` must exist."""
    out = [F.count(d).alias("_t"), F.avg(d).alias("_mean"), F.var_pop(d).alias("_g0")]
    for k in range(1, h):
        lagged = F.col(f"{d}_{k}")
        out += [
            F.covar_pop(F.when(lagged.isNotNull(), F.col(d)), lagged).alias(f"_c{k}"),
            F.avg(F.when(lagged.isNotNull(), F.col(d))).alias(f"_a{k}"),
            F.avg(lagged).alias(f"_b{k}"),
        ]
    return out


def dm_statistic(h: int = 1) -> Column:
    """The modified statistic from ``dm_aggregates`` columns.

    Autocovariance k is the mean of T-k products of deviations from the overall
    mean; an undefined variance (V <= 0) gives NULL.
    """
    t = F.col("_t")
    v = F.col("_g0")
    for k in range(1, h):
        gamma = F.col(f"_c{k}") + (F.col(f"_a{k}") - F.col("_mean")) * (F.col(f"_b{k}") - F.col("_mean"))
        v = v + 2 * gamma
    v = v / t
    shrink = F.sqrt((t + 1 - 2 * h + h * (h - 1) / t) / t)
    return F.when(v > 0, F.col("_mean") / F.sqrt(v) * shrink)
