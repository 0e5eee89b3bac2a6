"""Parameter search as one pass over all candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, at_home, lane, spread


def argmin(scores: DataFrame, by: Sequence[str], candidate: str, value: str) -> DataFrame:
    """The candidate with the smallest score per group."""
    return scores.groupBy(*by).agg(
        F.min_by(candidate, value).alias(candidate), F.min(value).alias(value)
    )


def sweep_half_widths(
    series: DataFrame, half_widths: Sequence[int], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Half width whose centred mean reconstructs the training part best (mean squared error).

    All candidates are scored over the same windows in one shuffle; only rows of the
    training part take part.
    """
    reach = max(half_widths)
    train = series.where(F.col("idx") < F.col("train_end"))
    rows = spread(train, before=reach, after=reach, block_rows=block_rows)
    gaps = {f"_e{h}": F.col("x") - F.avg("x").over(lane().rowsBetween(-h, h)) for h in half_widths}
    errors = at_home(rows.withColumns(gaps), block_rows).groupBy("series_id").agg(
        *[F.avg(F.col(f"_e{h}") * F.col(f"_e{h}")).alias(f"_e{h}") for h in half_widths]
    )
    scored = F.array(
        *[F.struct(F.lit(h).alias("half_width"), F.col(f"_e{h}").alias("mse")) for h in half_widths]
    )
    return argmin(errors.select("series_id", F.inline(scored)), ["series_id"], "half_width", "mse")
