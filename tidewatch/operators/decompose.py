"""One entry point to the decomposition kernels, and the check they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.centred import HALF_WIDTHS, decompose_centred, long_components
from tidewatch.operators.ensemble import ensemble_decompose
from tidewatch.operators.sift import sift_converged, sift_decompose

COLUMNS = ("series_id", "idx", "comp", "is_residual", "c")


def _centred(series: DataFrame, half_widths=HALF_WIDTHS) -> DataFrame:
    return long_components(decompose_centred(series, half_widths), len(half_widths) + 1)


def _linear_sift(series: DataFrame, levels: int = 3, passes: int = 3) -> DataFrame:
    return long_components(sift_decompose(series, levels, passes), levels + 1)


def _sift(series: DataFrame, **options) -> DataFrame:
    return sift_converged(series, **options)


def _ensemble(series: DataFrame, count: int = 10, **options) -> DataFrame:
    return long_components(ensemble_decompose(series, count, **options), count)


KERNELS: dict[str, Callable[..., DataFrame]] = {
    "centred": _centred,
    "linear_sift": _linear_sift,
    "sift": _sift,
    "ensemble": _ensemble,
}


def decompose(series: DataFrame, kernel: str | Callable[..., DataFrame] = "centred", **options) -> DataFrame:
    """``(series_id, idx, comp, is_residual, c)``: fastest component first, residual last.

    ``kernel`` is a name from ``KERNELS`` or a function from a series table to such rows.
    """
    build = KERNELS[kernel] if isinstance(kernel, str) else kernel
    return build(series, **options).select(*COLUMNS)


def reconstruction(components: DataFrame, series: DataFrame) -> DataFrame:
    """Per series: rows, components, and the largest error of their sum (also percent of range)."""
    sums = components.groupBy("series_id", "idx").agg(F.sum("c").alias("_total"), F.max("comp").alias("_comp"))
    joined = series.select("series_id", "idx", "x").join(sums, ["series_id", "idx"])
    off = F.abs(F.col("_total") - F.col("x"))
    return joined.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("_comp") + 1).alias("n_components"),
        F.max(off).alias("recon_max_err"),
        (F.max(off) * 100 / F.nullif(F.max("x") - F.min("x"), F.lit(0.0))).alias("recon_pct_of_range"),
    )
