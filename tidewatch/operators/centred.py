"""Centred-average decomposition: the native additive kernel.

Level j is the mean over ``h_j`` rows on either side, cut off at the ends of the
data; component j is the difference of neighbouring levels and the last level is
the residual.  Highest frequency comes first, the residual last, and the
components of a row add up to its value.  Like any two-sided decomposition it
uses rows after the one it describes, which is what the two protocols differ in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, SERIES, at_home, lane, spread

HALF_WIDTHS = (1, 2, 4, 8, 16)


def component_columns(order: WindowSpec, half_widths: Sequence[int] = HALF_WIDTHS, x: str = "x") -> dict[str, Column]:
    """``c0..cK`` over an ordered lane that already holds the neighbouring rows."""
    levels = [F.col(x), *[F.avg(x).over(order.rowsBetween(-h, h)) for h in half_widths]]
    details = {f"c{j}": a - b for j, (a, b) in enumerate(zip(levels, levels[1:]))}
    return {**details, f"c{len(half_widths)}": levels[-1]}


def decompose_centred(
    series: DataFrame, half_widths: Sequence[int] = HALF_WIDTHS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per index position with the components as columns ``c0..cK``."""
    reach = max(half_widths)
    rows = spread(series, before=reach, after=reach, block_rows=block_rows)
    return at_home(rows.withColumns(component_columns(lane(), half_widths)), block_rows).drop("block")


def long_components(wide: DataFrame, count: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """``(keys, comp, is_residual, idx, c)``, one row per component."""
    parts = F.array(
        *[
            F.struct(F.lit(j).alias("comp"), F.lit(j == count - 1).alias("is_residual"), F.col(f"c{j}").alias("c"))
            for j in range(count)
        ]
    )
    return wide.select(*keys, "idx", F.inline(parts))
