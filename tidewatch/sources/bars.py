"""High/Low bars from ticks, and the series tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.blocks import index_rows

WINDOW = 30
TRAIN_SHARE = 0.8


def bars(ticks: DataFrame, symbol: str, at: str, value: str, grain: str = "day") -> DataFrame:
    """``(symbol, day|hour, high, low)``: highest and lowest value per period.

    Max and min combine before the shuffle, so a hot symbol sends one row per
    period and input split, however many ticks it has.
    """
    period = F.to_date(at).alias("day") if grain == "day" else F.date_trunc(grain, F.col(at)).alias(grain)
    return ticks.groupBy(F.col(symbol).alias("symbol"), period).agg(
        F.max(value).alias("high"), F.min(value).alias("low")
    )


def complete_bars(bar_rows: DataFrame) -> DataFrame:
    """Drop a period for High and Low together when either is missing."""
    return bar_rows.na.drop(subset=["high", "low"])


def train_end(n: Column, window: int = WINDOW, share: float = TRAIN_SHARE) -> Column:
    """First test position of a series of ``n`` rows."""
    return (F.lit(window) + F.floor(F.lit(share) * (n - F.lit(window)))).cast("int")


def series_from_bars(bar_rows: DataFrame, at: str = "day") -> DataFrame:
    """``(series_id, <at>, idx, x, n, train_end)``, one series per symbol and price.

    Indexed once per symbol: after the joint drop High and Low share positions.
    """
    indexed = index_rows(complete_bars(bar_rows), ["symbol"], at)
    return (
        indexed.select("symbol", at, "idx", "n", F.expr("stack(2, 'High', high, 'Low', low) AS (which, x)"))
        .withColumn("series_id", F.concat_ws("_", "symbol", "which"))
        .select("series_id", at, "idx", "x", "n", train_end(F.col("n")).alias("train_end"))
    )


def walk_from_bars(bar_rows: DataFrame, start: float = 1e8) -> DataFrame:
    """Level series: ``start`` plus the running sum of demeaned High/Low, in cents.

    Whole cents keep every running sum exact in a double whatever the order of
    addition.  Same columns as ``series_from_bars``.
    """
    clean = complete_bars(bar_rows)
    cents = clean.select(
        "symbol", "day", F.round(F.col("high") * 100).alias("h"), F.round(F.col("low") * 100).alias("l")
    )
    indexed = index_rows(cents, ["symbol"], "day", sums=["h", "l"])
    long = indexed.select(
        "symbol",
        "day",
        "idx",
        "n",
        F.expr("stack(2, 'High', h_run, h_total, 'Low', l_run, l_total) AS (which, run, total)"),
    )
    step = F.round(F.col("total") / F.col("n"))
    return long.select(
        F.concat_ws("_", "symbol", "which").alias("series_id"),
        "day",
        "idx",
        (F.lit(start) + F.col("run") - (F.col("idx") + 1) * step).alias("x"),
        "n",
        train_end(F.col("n")).alias("train_end"),
    )
