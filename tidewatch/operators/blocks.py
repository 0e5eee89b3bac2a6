"""Ordered work on long series, split into blocks of rows.

A window partitioned by ``series_id`` alone puts a whole series into one task,
so one hot series would hold up the job.  Here every ordered operator is
partitioned by ``(series_id, block)`` instead, ``block`` being a fixed number of
consecutive index positions:

* bounded frames get the few rows they need from the neighbouring blocks as
  copies (``spread``), one shuffle for any number of frames;
* unbounded frames (running sums, last known value) combine an in-block frame
  with a carry from a table holding one row per block (``running``);
* per-series totals are attached by ``(series_id, block)`` so that the join key
  is never a hot series (``with_totals``).

``idx`` is a 32-bit position, so one series has at most 2**31 / BLOCK_ROWS
(about two million) rows in any per-block table.  That is the proven size of the
largest group such a table's own window ever sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
SERIES = ("series_id",)


def home_block(block_rows: int = BLOCK_ROWS) -> Column:
    """The block an index position belongs to."""
    return (F.col("idx") / F.lit(block_rows)).cast("int")


def spread(df: DataFrame, before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Assign rows to blocks, copying those a neighbouring block needs.

    Each block receives the ``before`` rows in front of it and the ``after`` rows
    behind it.  Compute frames over ``lane()``, then keep ``at_home()`` rows.
    """
    if not before and not after:
        return df.withColumn("block", home_block(block_rows))
    first = (F.greatest(F.col("idx") - F.lit(after), F.lit(0)) / F.lit(block_rows)).cast("int")
    last = ((F.col("idx") + F.lit(before)) / F.lit(block_rows)).cast("int")
    return df.withColumn("block", F.explode(F.sequence(first, last)))


def lane(keys: Sequence[str] = SERIES) -> WindowSpec:
    """Index order inside one block of one series."""
    return Window.partitionBy(*keys, "block").orderBy("idx")


def at_home(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Drop the copies made by ``spread``."""
    return df.where(F.col("block") == home_block(block_rows))


def join_totals(
    df: DataFrame,
    totals: DataFrame,
    last_idx: str,
    keys: Sequence[str] = SERIES,
    block_rows: int = BLOCK_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Attach one row per key group to its rows without a hot join key.

    ``totals`` holds one row per group with the group's largest index in
    ``last_idx``; it is repeated once per block, and the join runs on
    ``(keys, block)``.
    """
    per_block = totals.withColumn(
        "block", F.explode(F.sequence(F.lit(0), (F.col(last_idx) / F.lit(block_rows)).cast("int")))
    ).drop(last_idx)
    # Catalyst knows the size of ``totals`` only, not what it becomes per block: never a broadcast.
    return df.withColumn("block", home_block(block_rows)).join(per_block.hint("merge"), [*keys, "block"], how)


def with_totals(
    df: DataFrame,
    aggregates: Sequence[Column],
    keys: Sequence[str] = SERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Attach per-group aggregates (partially aggregated before the shuffle)."""
    totals = df.groupBy(*keys).agg(F.max("idx").alias("_last"), *aggregates)
    return join_totals(df, totals, "_last", keys, block_rows)


def running(
    df: DataFrame,
    outputs: dict[str, tuple[str, str]],
    keys: Sequence[str] = SERIES,
    block_rows: int = BLOCK_ROWS,
    exclusive: bool = False,
) -> DataFrame:
    """Add ``{output: (kind, input)}`` running aggregates over the whole series.

    ``kind`` is sum, min or max.  The in-block part is a window over one block;
    what came before is an exclusive running aggregate over the one-row-per-block
    table.  ``exclusive`` leaves the current row out.
    """
    kinds = {
        "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "min": (F.min, F.least),
        "max": (F.max, F.greatest),
    }
    rows = df.withColumn("block", home_block(block_rows))
    per_block = rows.groupBy(*keys, "block").agg(*[kinds[k][0](c).alias(f"_{o}") for o, (k, c) in outputs.items()])
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carries = per_block.select(
        *keys, "block", *[kinds[k][0](f"_{o}").over(earlier).alias(f"_{o}") for o, (k, _) in outputs.items()]
    )
    here = lane(keys).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    joined = rows.join(carries, [*keys, "block"])
    return joined.withColumns(
        {o: kinds[k][1](F.col(f"_{o}"), kinds[k][0](c).over(here)) for o, (k, c) in outputs.items()}
    ).drop(*[f"_{o}" for o in outputs])


def unplaced_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """What ``index_rows`` can't number: rows without a key or a time, counted by what they lack."""
    lacking = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in [*keys, order]])
    return df.withColumn("lacking", lacking).where(F.col("lacking") != "").groupBy("lacking").agg(F.count(F.lit(1)).alias("n_rows"))


def index_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str] = (),
    days_per_bucket: int = 512,
) -> DataFrame:
    """Number each group's rows 0..n-1 in time order, without one task per group.

    Rows are numbered inside a calendar bucket and shifted by the count of all
    earlier buckets.  ``order`` must be unique within a group (bars are), so a
    bucket holds at most ``days_per_bucket`` days of bars.  Rows without a key or a
    time have no place in any series; ``unplaced_rows`` reports them.  For every column in
    ``sums`` the same pass also yields ``<c>_run`` (running sum) and ``<c>_total``.
    """
    rows = df.withColumn("_bucket", F.floor(F.unix_date(F.to_date(order)) / F.lit(days_per_bucket)).cast("int"))
    # Stated up front so that both uses below share one filtered input (and one shuffle of it).
    for column in [*keys, "_bucket"]:
        rows = rows.where(F.col(column).isNotNull())
    coarse = rows.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_{c}") for c in sums]
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(group).cast("int").alias("n"),
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_{c}").over(group).alias(f"{c}_total") for c in sums],
    )
    bucket = Window.partitionBy(*keys, "_bucket").orderBy(order)
    here = bucket.rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, [*keys, "_bucket"])
    return joined.withColumns(
        {
            "idx": (F.col("_offset") + F.row_number().over(bucket) - 1).cast("int"),
            **{f"{c}_run": F.col(f"_before_{c}") + F.sum(c).over(here) for c in sums},
        }
    ).drop("_bucket", "_offset", *[f"_before_{c}" for c in sums])
