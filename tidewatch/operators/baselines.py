"""Benchmark forecasts that need no model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, at_home, lane, spread, with_totals

BASELINES = ("Persistence", "Drift", "MA-5", "MA-20", "EWMA-10")
#: Fixed value: exp(-1500) takes the largest double below the smallest one.
_NOTHING = 1500.0


def _ewma_plan(span: int, block_rows: int) -> tuple[float, int, int]:
    """Decay per row, a block size within which scale factors stay inside a double's range, and how many
    blocks back a value can be before it is smaller than any double."""
    rate = -math.log(1.0 - 2.0 / (span + 1.0))
    rows = max(min(block_rows, int(600.0 / rate)), 1)
    return rate, rows, math.ceil(_NOTHING / (rate * rows))


def ewma_carries(series: DataFrame, start: Column, span: int, block_rows: int) -> DataFrame:
    """``(series_id, block, carry)``: the smoothed value at the last row before each block.

    A block maps the value it is entered with to decay * value + offset. Offsets are sums over the rows, combined
    before they move; the maps of the blocks before are then composed, on a table of one row per block.
    """
    rate, rows, reach = _ewma_plan(span, block_rows)
    weight = lambda row: F.exp((F.pmod(row, F.lit(rows)) - (rows - 1)) * F.lit(rate))
    following, first = F.col("idx") + 1, start - 1
    # A value enters at the row after it; the seed, a mean of the last training rows, enters at the last of them.
    entered = series.where(following >= start).groupBy("series_id", (following / F.lit(rows)).cast("int").alias("block")).agg(
        F.sum(F.col("x") * (2.0 / (span + 1.0)) * weight(following)).alias("offset")
    )
    seeds = series.where((F.col("idx") <= first) & (F.col("idx") > first - span)).groupBy("series_id", first.alias("_row")).agg(F.avg("x").alias("_seed"))
    seeds = seeds.select("series_id", (F.col("_row") / F.lit(rows)).cast("int").alias("block"), (F.col("_seed") * weight(F.col("_row"))).alias("offset"))
    blocks = entered.unionByName(seeds).groupBy("series_id", "block").agg(F.sum("offset").alias("offset"))
    before = Window.partitionBy("series_id").orderBy("block").rowsBetween(-reach, -1)
    decay = math.exp(-rate * rows)
    carry = F.aggregate(F.collect_list("offset").over(before), F.lit(0.0), lambda value, offset: value * decay + offset)
    return blocks.select("series_id", "block", carry.alias("_carry"))


def benchmark_forecasts(
    series: DataFrame,
    test_start: str = "train_end",
    averages: tuple[int, ...] = (5, 20),
    span: int = 10,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All benchmark forecasts of every test row, as columns next to ``y``.

    ``test_start`` names the column with the first scored position.  The EWMA
    recursion is a running sum of terms scaled by the decay, relative to the block, plus
    the value with which the block is entered (``ewma_carries``): nothing is forgotten.
    """
    rate, rows_per_block, _ = _ewma_plan(span, block_rows)
    before = max(*averages, span) + 1
    start = F.col(test_start)

    slope = with_totals(
        series,
        [
            F.max(F.when(F.col("idx") == 0, F.col("x"))).alias("_x0"),
            F.max(F.when(F.col("idx") == start - 1, F.col("x"))).alias("_xs"),
        ],
        block_rows=rows_per_block,
    )
    rows = spread(slope.drop("block"), before=before, block_rows=rows_per_block)
    rows = rows.join(ewma_carries(series, start, span, rows_per_block).hint("merge"), ["series_id", "block"], "left")
    order = lane()
    prior = F.lag("x", 1).over(order)
    position = F.col("idx") - F.col("block") * F.lit(rows_per_block)
    seed = F.avg("x").over(order.rowsBetween(-(span - 1), 0))
    term: Column = (
        F.when(position < 0, F.lit(0.0))  # copies from the block before are in the carry
        .when(F.col("idx") == start - 1, F.col("_seed"))
        .when(F.col("idx") >= start, F.col("persistence") * (2.0 / (span + 1.0)))
        .otherwise(F.lit(0.0))
    )
    rows = rows.select(
        "*",
        prior.alias("persistence"),
        seed.alias("_seed"),
        *[F.avg("x").over(order.rowsBetween(-k, -1)).alias(f"ma{k}") for k in averages],
    )
    rows = rows.withColumn("_term", term * F.exp(F.greatest(position, F.lit(0)) * F.lit(rate)))
    rows = rows.withColumn(
        "ewma",
        F.sum("_term").over(order.rowsBetween(Window.unboundedPreceding, 0)) * F.exp(-position * F.lit(rate))
        + F.coalesce("_carry", F.lit(0.0)) * F.exp(-(position + 1) * F.lit(rate)),
    )
    drift = (F.col("_xs") - F.col("_x0")) / F.greatest(start - 1, F.lit(1))
    return (
        at_home(rows, rows_per_block)
        .where(F.col("idx") >= start)
        .select(
            "series_id",
            "idx",
            F.col("x").alias("y"),
            "persistence",
            (F.col("persistence") + drift).alias("drift"),
            *[f"ma{k}" for k in averages],
            F.col("ewma").alias(f"ewma{span}"),
        )
    )


def long_forecasts(wide: DataFrame) -> DataFrame:
    """``(series_id, idx, y, persistence, baseline, y_pred)``, one row per benchmark."""
    return wide.select(
        "series_id",
        "idx",
        "y",
        "persistence",
        F.expr(
            "stack(5, 'Persistence', persistence, 'Drift', drift, 'MA-5', ma5, 'MA-20', ma20,"
            " 'EWMA-10', ewma10) AS (baseline, y_pred)"
        ),
    )
