"""Scales fitted on training windows only, and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, join_totals, with_totals

DATASET_COMPONENT = ("series_id", "protocol", "comp")


def last_value(w: str = "w") -> Column:
    return F.element_at(w, -1)


def in_training(value: Column) -> Column:
    return F.when(F.col("split") == "train", value)


def training_elements(windows: DataFrame) -> DataFrame:
    """Training windows with one row per element: ``pos``, ``dev`` from the last value.

    Feeds aggregates only, so the extra rows are combined where they arise and never
    shuffled.  ``once(c)`` selects a column's value a single time per window.
    """
    rows = windows.where(F.col("split") == "train").withColumn("last", last_value())
    return rows.select("*", F.posexplode("w").alias("pos", "_v")).withColumn("dev", F.col("_v") - F.col("last"))


def once(value: Column) -> Column:
    return F.when(F.col("pos") == 0, value)


def last_value_scales() -> list[Column]:
    """``s_in``, ``s_out``: spread of all training deviations from each window's last value.

    Aggregates over ``training_elements``; a spread of zero becomes 1.
    """
    s_in = F.stddev_pop("dev")
    s_out = F.stddev_pop(once(F.col("y") - F.col("last")))
    return [
        F.when(s_in > 0, s_in).otherwise(1.0).alias("s_in"),
        F.when(s_out > 0, s_out).otherwise(1.0).alias("s_out"),
    ]


def scale_windows(windows: DataFrame, method: str = "last_value", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the scaled window ``sw`` and scaled target ``sy``; both scales come from training rows."""
    if method == "last_value":
        scales = training_elements(windows).groupBy(*DATASET_COMPONENT).agg(
            (F.max("n") - 1).alias("_last_idx"), *last_value_scales()
        )
        rows = join_totals(windows, scales, "_last_idx", DATASET_COMPONENT, block_rows)
        return rows.withColumns(
            {
                "sw": F.transform("w", lambda v: (v - last_value()) / F.col("s_in")),
                "sy": (F.col("y") - last_value()) / F.col("s_out"),
            }
        )
    if method == "minmax":
        low = F.min(in_training(F.least(F.array_min("w"), F.col("y"))))
        high = F.max(in_training(F.greatest(F.array_max("w"), F.col("y"))))
        width = F.when(high > low, high - low).otherwise(1.0)
        rows = with_totals(windows, [low.alias("low"), width.alias("width")], DATASET_COMPONENT, block_rows)
        return rows.withColumns(
            {
                "sw": F.transform("w", lambda v: (v - F.col("low")) / F.col("width")),
                "sy": (F.col("y") - F.col("low")) / F.col("width"),
            }
        )
    raise ValueError(f"unknown scaling method: {method}")


def unscale(scaled: str, method: str = "last_value") -> Column:
    """A scaled forecast back in component units."""
    if method == "last_value":
        return last_value() + F.col(scaled) * F.col("s_out")
    return F.col("low") + F.col(scaled) * F.col("width")


def out_of_range_share(windows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per component: share of test targets outside the range training targets span."""
    y = F.col("y")
    rows = with_totals(
        windows,
        [F.min(in_training(y)).alias("low"), F.max(in_training(y)).alias("high")],
        DATASET_COMPONENT,
        block_rows,
    )
    outside = (y < F.col("low")) | (y > F.col("high"))
    return (
        rows.where(F.col("split") == "test")
        .groupBy(*DATASET_COMPONENT)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(outside.cast("int")).alias("share"))
    )
