"""Sifting with linear envelopes, entirely as DataFrame operations.

An envelope runs through a series' local extrema, however far apart they are, so
a block cannot see all it needs by copying a few neighbours.  Each pass therefore
builds one row per block (its first and last extremum, their number, sum of
values), carries those across blocks, and interpolates inside the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, SERIES, at_home, lane, spread, with_totals
from tidewatch.session import cut_lineage

_FEWEST_EXTREMA = 4


def mark_extrema(rows: DataFrame, value: str = "x", block_rows: int = BLOCK_ROWS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add ``is_max`` and ``is_min``: strictly above or below both neighbours."""
    spread_rows = spread(rows, before=1, after=1, block_rows=block_rows)
    v, back, ahead = F.col(value), F.lag(value).over(lane(keys)), F.lead(value).over(lane(keys))
    marked = spread_rows.withColumns(
        {
            "is_max": F.coalesce((v > back) & (v > ahead), F.lit(False)),
            "is_min": F.coalesce((v < back) & (v < ahead), F.lit(False)),
        }
    )
    return at_home(marked, block_rows)


def _interpolate(before: Column, after: Column) -> Column:
    """Straight line between two extrema; flat beyond the first and last one."""
    left, right = F.coalesce(before, after), F.coalesce(after, before)
    width = right["idx"] - left["idx"]
    return F.when(
        width > 0, left["v"] + (right["v"] - left["v"]) * (F.col("idx") - left["idx"]) / F.nullif(width, F.lit(0))
    ).otherwise(left["v"])


def linear_envelopes(rows: DataFrame, value: str = "x", block_rows: int = BLOCK_ROWS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add ``upper`` and ``lower``; a side with fewer than four extrema is the mean of the series."""
    marked = mark_extrema(rows, value, block_rows, keys)
    point = F.struct(F.col("idx").alias("idx"), F.col(value).alias("v"))
    marked = marked.withColumns({"_top": F.when(F.col("is_max"), point), "_low": F.when(F.col("is_min"), point)})
    per_block = marked.groupBy(*keys, "block").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("_top", "_low") for f, n in ((F.min, "first"), (F.max, "last"), (F.count, "n"))],
        F.sum(value).alias("_sum"),
        F.count(value).alias("_count"),
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Looking ahead is a running frame in reverse order: linear, where a frame that
    # ends at the last row would be evaluated from scratch for every row.
    later = whole.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys,
        "block",
        *[F.max(f"{c}_last").over(earlier).alias(f"{c}_before") for c in ("_top", "_low")],
        *[F.min(f"{c}_first").over(later).alias(f"{c}_after") for c in ("_top", "_low")],
        *[F.sum(f"{c}_n").over(whole).alias(f"{c}_total") for c in ("_top", "_low")],
        (F.sum("_sum").over(whole) / F.sum("_count").over(whole)).alias("_mean"),
    )
    joined = marked.join(carried, [*keys, "block"])
    so_far = lane(keys).rowsBetween(Window.unboundedPreceding, 0)
    from_here = (
        Window.partitionBy(*keys, "block").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    )

    def envelope(c: str) -> Column:
        before = F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"{c}_before"))
        after = F.coalesce(F.last(c, ignorenulls=True).over(from_here), F.col(f"{c}_after"))
        return F.when(F.col(f"{c}_total") < _FEWEST_EXTREMA, F.col("_mean")).otherwise(_interpolate(before, after))

    kept = [c for c in rows.columns if c != "block"]
    return joined.withColumns({"upper": envelope("_top"), "lower": envelope("_low")}).select(*kept, "upper", "lower")


def sift_pass(rows: DataFrame, value: str = "x", block_rows: int = BLOCK_ROWS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Take the mean of both envelopes off ``value``."""
    enveloped = linear_envelopes(rows, value, block_rows, keys)
    return enveloped.withColumn(value, F.col(value) - (F.col("upper") + F.col("lower")) / 2).drop("upper", "lower")


def sift_decompose(
    series: DataFrame, levels: int = 3, passes: int = 3, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Components ``c0..c<levels>`` by a fixed number of passes per level.

    A pass reads its input twice, so without a cut the plan would double with every
    pass; each pass is written to the shared folder.
    """
    rows = series.select("series_id", "idx", "x", F.col("x").alias("rest"))
    for level in range(levels):
        rows = rows.withColumn("h", F.col("rest"))
        for _ in range(passes):
            rows = cut_lineage(sift_pass(rows, "h", block_rows))
        rows = rows.withColumns({f"c{level}": F.col("h"), "rest": F.col("rest") - F.col("h")}).drop("h")
    return rows.withColumnRenamed("rest", f"c{levels}")


def levels_worth_sifting(decomposed: DataFrame, levels: int, keys: Sequence[str] = SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(keys, n_levels, tops, lows)``: how many of a decomposition's leading levels were taken from a rest with four maxima and minima or more.

    ``decomposed`` has ``c0..c<levels>``; the rest before level j is the sum of the components from j on. ``tops`` and ``lows`` count
    the extrema of all those rests and of the last one.
    """
    rests = {f"_r{j}": sum((F.col(f"c{k}") for k in range(j + 1, levels + 1)), F.col(f"c{j}")) for j in range(levels + 1)}
    rows = spread(decomposed.select(*keys, "idx", *[c.alias(n) for n, c in rests.items()]), before=1, after=1, block_rows=block_rows)
    beside = lane(keys)
    marks = {}
    for name in rests:
        v, back, ahead = F.col(name), F.lag(name).over(beside), F.lead(name).over(beside)
        marks |= {f"{name}_top": (v > back) & (v > ahead), f"{name}_low": (v < back) & (v < ahead)}
    counted = at_home(rows.withColumns(marks), block_rows).groupBy(*keys).agg(*[F.count_if(m).alias(m) for m in marks])
    enough = [F.least(f"{n}_top", f"{n}_low") >= _FEWEST_EXTREMA for n in list(rests)[:levels]]
    reached = F.lit(0)
    for ok in reversed(enough):
        reached = F.when(ok, reached + 1).otherwise(F.lit(0))
    total = lambda side: sum((F.col(f"{n}_{side}") for n in list(rests)[1:]), F.col(f"_r0_{side}"))
    return counted.select(*keys, reached.cast("int").alias("n_levels"), total("top").alias("tops"), total("low").alias("lows"))


def sift_converged(
    series: DataFrame,
    keys: Sequence[str] = SERIES,
    value: str = "x",
    levels: int = 10,
    tolerance: float = 0.2,
    most_passes: int = 100,
    least_spread: float = 0.01,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Components by sifting every group until it changes little: ``(keys, idx, comp, is_residual, c, converged)``.

    A group's component is done once a pass changes it by less than ``tolerance`` (squared change over squared
    value), and its decomposition once its rest has fewer than four maxima or minima or a spread below
    ``least_spread`` of the input's. Groups that are done are set aside, so passes get cheaper. Every row
    of every group has a residual, so the components of a row add up to it. ``converged`` is false
    for components that ran into ``most_passes`` and for a residual that ran into ``levels``.
    """
    picked = series.select(*keys, "idx", F.col(value).cast("double").alias("rest"))
    rows = cut_lineage(with_totals(picked, [F.stddev_pop("rest").alias("_spread")], keys, block_rows).drop("block"))
    parts: list[DataFrame] = []
    shape = lambda df, comp, last, sure: df.select(
        *keys, "idx", F.lit(comp).alias("comp"), F.lit(last).alias("is_residual"), F.col("rest" if last else "h").alias("c"), F.lit(sure).alias("converged")
    )
    for level in range(levels + 1):
        marked = mark_extrema(rows, "rest", block_rows, keys).drop("block")
        few = F.least(F.count_if("is_max"), F.count_if("is_min")) < _FEWEST_EXTREMA
        flat = F.stddev_pop("rest") <= F.max("_spread") * least_spread
        judged = cut_lineage(with_totals(marked, [(few | flat).alias("_over")], keys, block_rows).drop("block", "is_max", "is_min"))
        parts.append(shape(judged.where("_over"), level, True, True))
        rows = judged.where(~F.col("_over")).drop("_over")
        if level == levels:
            parts.append(shape(rows, level, True, False))
            break
        if rows.isEmpty():
            break
        open_rows, done = rows.withColumn("h", F.col("rest")), []
        for turn in range(most_passes):
            passed = sift_pass(open_rows.withColumn("_was", F.col("h")), "h", block_rows, keys)
            change = F.sum(F.pow(F.col("h") - F.col("_was"), F.lit(2.0))) / F.nullif(F.sum(F.pow("_was", F.lit(2.0))), F.lit(0.0))
            passed = with_totals(cut_lineage(passed), [(F.coalesce(change, F.lit(0.0)) < tolerance).alias("_done")], keys, block_rows)
            passed = cut_lineage(passed.drop("block", "_was"))
            done.append((passed.where("_done").drop("_done"), True))
            open_rows = passed.where(~F.col("_done")).drop("_done")
            if open_rows.isEmpty():
                break
            if turn == most_passes - 1:
                done.append((open_rows, False))
        found = None
        for table, sure in done:
            parts.append(shape(table, level, False, sure))
            found = table if found is None else found.unionByName(table)
        rows = found.withColumn("rest", F.col("rest") - F.col("h")).drop("h")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
