"""One-step linear forecasts per component, and their sum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.linear import coefficients, moments
from tidewatch.operators.blocks import BLOCK_ROWS, join_totals
from tidewatch.operators.scaling import DATASET_COMPONENT, last_value, last_value_scales, once, training_elements

MODELS = {"lag1": 1, "lag2": 2}
DATASET_MODEL = ("series_id", "protocol", "model")


def component_forecasts(
    windows: DataFrame, models: dict[str, int] = MODELS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``p`` per (series, protocol, comp, model, idx): scaled lags in, change to the next value out.

    A model with k lags regresses the scaled change on the k values before the last
    one, relative to the last.  Scales and normal equations come from one aggregate
    over the training rows; a singular fit forecasts no change.
    """
    most = max(models.values())
    lags = {f"_f{k}": F.element_at("w", -1 - k) - last_value() for k in range(1, most + 1)}
    rows = windows.withColumns({"last": last_value(), "_dy": F.col("y") - last_value(), **lags})
    elements = training_elements(rows).withColumns({c: once(F.col(c)) for c in ("_dy", *lags)})
    totals = elements.groupBy(*DATASET_COMPONENT).agg(
        (F.max("n") - 1).alias("_last_idx"), *last_value_scales(), *moments("_dy", list(lags))
    )
    solved = totals
    for name, k in models.items():
        solved = solved.withColumns({f"_{name}_{b}": v for b, v in coefficients(k).items()})
    keep = [f"_{name}_b{i}" for name, k in models.items() for i in range(k + 1)]
    solved = solved.select(*DATASET_COMPONENT, "_last_idx", "s_in", "s_out", *keep)

    joined = join_totals(rows, solved, "_last_idx", DATASET_COMPONENT, block_rows)
    scaled = {}
    for name, k in models.items():
        # Coefficients in scaled units: b * s_in / s_out applied to lag / s_in.
        change = F.col(f"_{name}_b0") / F.col("s_out")
        for i in range(1, k + 1):
            slope = F.col(f"_{name}_b{i}") * F.col("s_in") / F.col("s_out")
            change = change + slope * (F.col(f"_f{i}") / F.col("s_in"))
        scaled[name] = F.coalesce(change, F.lit(0.0))
    parts = F.array(
        *[
            F.struct(F.lit(name).alias("model"), (F.col("last") + F.col("s_out") * v).alias("p"))
            for name, v in scaled.items()
        ]
    )
    return joined.select(
        *DATASET_COMPONENT, "idx", "split", "test_start", "n", "x", "y", "last", F.inline(parts)
    )


def assemble(parts: DataFrame, expected: int) -> DataFrame:
    """Sum of component forecasts per row, with ``n_parts`` and ``is_complete``.

    A row that lacks a component keeps its target and has no forecast, so that a caller can refuse it or report it.
    """
    return (
        parts.groupBy(*DATASET_MODEL, "idx", "split", "test_start")
        .agg(
            F.max("x").alias("y"),
            F.sum("p").alias("y_pred"),
            F.sum("last").alias("input_last"),
            F.count("p").alias("n_parts"),
        )
        .withColumn("is_complete", F.col("n_parts") == expected)
        .withColumns({c: F.when(F.col("is_complete"), F.col(c)) for c in ("y_pred", "input_last")})
    )


def complete(forecasts: DataFrame) -> DataFrame:
    """Rows with a forecast from every component."""
    return forecasts.where("is_complete").drop("n_parts", "is_complete")


def assembly_gaps(forecasts: DataFrame) -> DataFrame:
    """Per dataset and model: rows that can't be used for want of a component, and the fewest parts any row has."""
    return forecasts.groupBy(*DATASET_MODEL).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("is_complete")).alias("n_incomplete"), F.min("n_parts").alias("fewest_parts")
    )


def bias_corrected(forecasts: DataFrame, keys: Sequence[str] = DATASET_MODEL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Affine correction of test forecasts, fitted on the last tenth of the training rows (at least 10)."""
    train = F.col("split") == "train"
    first = F.min("idx")
    bounds = forecasts.groupBy(*keys).agg(
        F.max("idx").alias("_last_idx"),
        (F.max("test_start") - F.greatest(F.lit(10), F.floor((F.max("test_start") - first) * 0.1)))
        .cast("int")
        .alias("_tail"),
    )
    rows = join_totals(forecasts, bounds, "_last_idx", keys, block_rows)
    tail = train & (F.col("idx") >= F.col("_tail"))
    y, p = F.when(tail, F.col("y")), F.when(tail, F.col("y_pred"))
    fit = rows.groupBy(*keys).agg(
        F.max("idx").alias("_last_idx"), F.regr_slope(y, p).alias("a"), F.regr_intercept(y, p).alias("b")
    )
    fixed = join_totals(rows.drop("block", "_tail").where(~train), fit, "_last_idx", keys, block_rows)
    return fixed.withColumn("y_corrected", F.col("a") * F.col("y_pred") + F.col("b")).drop("block")
