"""Windows and histories of a series, as of each forecast origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, at_home, lane, running, spread, with_totals
from tidewatch.operators.ensemble import standard_normal
from tidewatch.sources.bars import WINDOW


def with_split(series: DataFrame) -> DataFrame:
    """Label every row that can be a target: ``train`` before the split, ``test`` from it on."""
    return series.where(F.col("idx") >= WINDOW).withColumn(
        "split", F.when(F.col("idx") < F.col("train_end"), "train").otherwise("test")
    )


def sliding_windows(series: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``w`` = the ``window`` values before each row, oldest first; ``y`` = the row's own value."""
    rows = spread(series, before=window, block_rows=block_rows)
    rows = rows.withColumn("w", F.collect_list("x").over(lane().rowsBetween(-window, -1)))
    return (
        at_home(rows, block_rows)
        .where(F.col("idx") >= window)
        .withColumn("y", F.col("x"))
        .withColumn("split", F.when(F.col("idx") < F.col("train_end"), "train").otherwise("test"))
        .drop("block", "x")
    )


def history_summary(series: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What is known of a series at each test origin: aggregates of all rows before it.

    The as-of history of every origin is quadratic in the length of a series when
    written out; as running aggregates it is one row per origin.
    """
    known = running(
        series,
        {"hist_sum": ("sum", "x"), "hist_min": ("min", "x"), "hist_max": ("max", "x")},
        block_rows=block_rows,
        exclusive=True,
    )
    return known.where(F.col("idx") >= F.col("train_end")).select(
        "series_id",
        F.col("idx").alias("origin"),
        F.col("idx").alias("hist_rows"),
        "hist_sum",
        (F.col("hist_sum") / F.col("idx")).alias("hist_mean"),
        "hist_min",
        "hist_max",
    )


def even_history_summary(series: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same for the even-length history that drops the oldest row before an odd origin."""
    known = running(series, {"all_sum": ("sum", "x")}, block_rows=block_rows, exclusive=True)
    known = with_totals(known, [F.max(F.when(F.col("idx") == 0, F.col("x"))).alias("x0")], block_rows=block_rows)
    odd = F.col("idx") % 2
    return known.where(F.col("idx") >= F.col("train_end")).select(
        "series_id",
        F.col("idx").alias("origin"),
        odd.alias("first_idx"),
        (F.col("idx") - odd).alias("hist_rows"),
        (F.col("all_sum") - odd * F.col("x0")).alias("hist_sum"),
    )


def origin_tail(series: DataFrame, rows: int = WINDOW) -> DataFrame:
    """The last ``rows`` rows known at every test origin, in long form.

    A row belongs to the next ``rows`` origins, so it is sent there directly: no
    join, no shuffle, output of exactly ``rows`` per origin.
    """
    first = F.greatest(F.col("idx") + 1, F.col("train_end"))
    last = F.least(F.col("idx") + rows, F.col("n") - 1)
    return (
        series.where(first <= last)
        .withColumn("origin", F.explode(F.sequence(first, last)))
        .select("series_id", "origin", "idx", (F.col("idx") - F.col("origin") + rows).alias("pos"), "x")
    )


def refit_windows(windows: DataFrame, stride: int) -> DataFrame:
    """Test rows served by the latest refit at or before them, one refit every ``stride`` rows."""
    test = windows.where(F.col("split") == "test")
    step = F.col("idx") - F.col("train_end")
    refits = test.where(step % stride == 0).select("series_id", F.col("idx").alias("refit_idx"), "w")
    wanted = test.withColumn("refit_idx", F.col("idx") - step % stride).drop("w")
    return wanted.join(refits, ["series_id", "refit_idx"])


def trace_rows(series: DataFrame, rows: int = 100) -> DataFrame:
    """The first ``rows`` test rows of every series, for a trace chart."""
    return series.where(
        (F.col("idx") >= F.col("train_end")) & (F.col("idx") < F.col("train_end") + rows)
    )


def synthetic_components(calendar: DataFrame) -> DataFrame:
    """Trend plus slow and fast waves on the positions of existing series.

    Fixed values: level 5000 and 0.5 per row; wave 30 with period 40; wave 10 with period 9.
    """
    t = F.col("idx").cast("double")
    return calendar.select(
        "series_id",
        "idx",
        (F.lit(10.0) * F.sin(2 * F.pi() * t / 9)).alias("fast"),
        (F.lit(30.0) * F.sin(2 * F.pi() * t / 40)).alias("slow"),
        (F.lit(5000.0) + 0.5 * t).alias("trend"),
    ).withColumn("x", F.col("fast") + F.col("slow") + F.col("trend"))


def synthetic_series(
    calendar: DataFrame, walk_std: float = 3.0, noise_std: float = 2.0, seed: int = 0
) -> DataFrame:
    """The same with a random walk in the trend and noise on the fast wave.

    Both come from hashes of the position, so they survive a recomputed task.
    """
    parts = synthetic_components(calendar).drop("x")
    stepped = parts.withColumn("_step", walk_std * standard_normal("series_id", "idx", seed=seed))
    walked = running(stepped, {"_walk": ("sum", "_step")})
    return walked.select(
        "series_id",
        "idx",
        (F.col("fast") + noise_std * standard_normal("series_id", "idx", seed=seed + 1)).alias("fast"),
        "slow",
        (F.col("trend") + F.col("_walk")).alias("trend"),
    ).withColumn("x", F.col("fast") + F.col("slow") + F.col("trend"))
