"""Component windows under the two evaluation protocols.

``full_series``: the whole series is decomposed once, then split; components at a
test row have seen later rows.  ``walk_forward``: training rows come from the
training part alone, and the window of test row t from the history before t; its
component target is the newest row of the history up to and including t.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, at_home, lane, spread
from tidewatch.operators.centred import HALF_WIDTHS, component_columns
from tidewatch.sources.bars import WINDOW

FULL = "full_series"
WALK = "walk_forward"


def _one_row_per_component(rows: DataFrame, count: int, protocol: str, split: Column) -> DataFrame:
    parts = F.array(
        *[
            F.struct(F.lit(j).alias("comp"), F.col(f"w{j}").alias("w"), F.col(f"y{j}").alias("y"))
            for j in range(count)
        ]
    )
    return rows.select(
        "series_id",
        F.lit(protocol).alias("protocol"),
        "idx",
        "x",
        "n",
        F.col("test_start"),
        split.alias("split"),
        F.inline(parts),
    )


def _windows_of_decomposed(
    series: DataFrame, half_widths: Sequence[int], window: int, block_rows: int
) -> DataFrame:
    """Decompose exactly the given rows, then cut windows; one shuffle for both."""
    reach = max(half_widths)
    count = len(half_widths) + 1
    rows = spread(series, before=window + reach, after=reach, block_rows=block_rows)
    order = lane()
    rows = rows.withColumns(component_columns(order, half_widths))
    back = order.rowsBetween(-window, -1)
    rows = rows.withColumns(
        {
            **{f"w{j}": F.collect_list(f"c{j}").over(back) for j in range(count)},
            **{f"y{j}": F.col(f"c{j}") for j in range(count)},
        }
    )
    return at_home(rows, block_rows).where(F.col("idx") >= window)


def full_series_windows(
    series: DataFrame,
    half_widths: Sequence[int] = HALF_WIDTHS,
    window: int = WINDOW,
    trim_newest: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Windows cut from one decomposition of the whole series.

    ``trim_newest`` leaves out that many newest rows and moves the split by as
    much, as an even-length decomposition does.
    """
    kept = series.where(F.col("idx") < F.col("n") - trim_newest).withColumn(
        "test_start", F.col("train_end") - trim_newest
    )
    rows = _windows_of_decomposed(kept, half_widths, window, block_rows)
    split = F.when(F.col("idx") < F.col("test_start"), "train").otherwise("test")
    return _one_row_per_component(rows, len(half_widths) + 1, FULL, split)


def walk_forward_windows(
    series: DataFrame,
    half_widths: Sequence[int] = HALF_WIDTHS,
    window: int = WINDOW,
    trim_end_to_even: bool = False,
    block_rows: int = BLOCK_ROWS,
    stride: int = 1,
) -> DataFrame:
    """Windows in which nothing at or after the forecast row is used.

    Only the last rows of each origin's decomposition are needed, and each of them
    is a mean over a bounded stretch, so the work is linear in the length of the
    series: running sums inside a block give every mean by one subtraction.

    ``trim_end_to_even`` reproduces a known fault: cutting odd-length histories at
    their newest end, so that windows of odd rows end one row early and targets of
    even rows repeat the row before.

    With ``stride`` the history is decomposed at every stride-th test row only; the rows up to the next one use
    the window of that refit. Their targets stay their own.
    """
    count = len(half_widths) + 1
    marked = series.withColumn("test_start", F.col("train_end"))
    train = _windows_of_decomposed(marked.where(F.col("idx") < F.col("train_end")), half_widths, window, block_rows)

    reach = window + max(half_widths) + 2
    rows = spread(marked, before=reach, block_rows=block_rows)
    order = lane()
    rows = rows.withColumn("_run", F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    back = order.rowsBetween(-reach, 0)
    rows = rows.withColumns({"_runs": F.collect_list("_run").over(back), "_xs": F.collect_list("x").over(back)})
    rows = at_home(rows, block_rows).where(F.col("idx") >= F.col("train_end"))

    t = F.col("idx")
    lost = t % 2 if trim_end_to_even else F.lit(0)
    end = t - lost - 1  # newest row a window may use
    target = t - (t + 1) % 2 if trim_end_to_even else t

    # Slot q - t + reach + 1 of the padded sums holds position q; the sum before the
    # first row of a series is zero, which the padding supplies.
    missing = F.lit(reach + 1) - F.size("_runs")
    padded = F.when(missing > 0, F.concat(F.array_repeat(F.lit(0.0), missing), F.col("_runs"))).otherwise(F.col("_runs"))
    rows = rows.withColumn("_sums", padded)

    def sum_to(position: Column) -> Column:
        return F.get("_sums", position - t + reach)

    def levels_of_window(half: int) -> Column:
        """Means around each window position of a history that ends at ``end``."""
        if half == 0:
            return F.slice("_xs", -(lost + window + 1), F.lit(window))
        inside = max(window - half, 0)
        cut = F.array_repeat(sum_to(end), window - inside)
        upper = F.concat(F.slice("_sums", F.lit(reach + 1 - window + half) - lost, F.lit(inside)), cut)
        lower = F.slice("_sums", F.lit(reach - window - half) - lost, F.lit(window))
        behind = [min(half, window - 1 - k) for k in range(window)]
        full = F.array(*[F.lit(float(half + b + 1)) for b in behind])
        short = F.transform(
            F.array(*[F.lit(b) for b in behind]),
            lambda b, k: (b + 1 + F.least(F.lit(half), end - window + 1 + k)).cast("double"),
        )
        counts = F.when(t >= reach, full).otherwise(short)
        return F.zip_with(F.zip_with(upper, lower, lambda a, b: a - b), counts, lambda s, c: s / c)

    def level_of_target(half: int) -> Column:
        if half == 0:
            return F.element_at("_xs", -(t - target) - 1)
        first = F.greatest(target - half, F.lit(0))
        return (sum_to(target) - F.coalesce(sum_to(first - 1), F.lit(0.0))) / (target - first + 1)

    widths = (0, *half_widths)
    rows = rows.withColumns(
        {
            **{f"_l{j}": levels_of_window(h) for j, h in enumerate(widths)},
            **{f"_t{j}": level_of_target(h) for j, h in enumerate(widths)},
        }
    )
    last = count - 1
    rows = rows.withColumns(
        {
            **{f"w{j}": F.zip_with(f"_l{j}", f"_l{j + 1}", lambda a, b: a - b) for j in range(last)},
            f"w{last}": F.col(f"_l{last}"),
            **{f"y{j}": F.col(f"_t{j}") - F.col(f"_t{j + 1}") for j in range(last)},
            f"y{last}": F.col(f"_t{last}"),
        }
    )
    if stride > 1:
        late = (t - F.col("test_start")) % stride
        windows = [f"w{j}" for j in range(count)]
        # Only these rows' windows are built; each serves fewer than ``stride`` others.
        refits = rows.where(late == 0).select("series_id", t.alias("_refit"), *windows)
        rows = rows.drop(*windows).withColumn("_refit", t - late).join(refits, ["series_id", "_refit"]).drop("_refit")
    return _one_row_per_component(train, count, WALK, F.lit("train")).unionByName(
        _one_row_per_component(rows, count, WALK, F.lit("test"))
    )
