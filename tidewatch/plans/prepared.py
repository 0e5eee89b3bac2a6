"""Bars, series, splits, windows and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.blocks import at_home, lane, spread, unplaced_rows
from tidewatch.operators.prepare import (
    even_history_summary,
    history_summary,
    origin_tail,
    refit_windows,
    sliding_windows,
    synthetic_components,
    trace_rows,
    with_split,
)
from tidewatch.plans.inputs import event_bars, item_bars, item_series, order_bars, walk
from tidewatch.plans.registry import fragment, query, using
from tidewatch.sources.bars import complete_bars, series_from_bars
from tidewatch.sources.tables import table

STRIDE = 5

fragment(
    "win",
    "series",
    sql="""SELECT series_id, idx, n, train_end, x AS y,
    list(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS w
    FROM series QUALIFY idx >= 30""",
)


def window_shape(w: str = "w") -> list:
    """A window as hash-friendly scalars: four of its elements, its size, its extremes, and a sum that weights every element by its place."""
    return [
        F.round(F.get(w, F.lit(0)), 4).alias("w_first"),
        F.round(F.get(w, F.lit(9)), 4).alias("w_10"),
        F.round(F.get(w, F.lit(19)), 4).alias("w_20"),
        F.round(F.element_at(w, -1), 4).alias("w_last"),
        F.size(w).alias("w_size"),
        F.round(F.array_min(w), 4).alias("w_min"),
        F.round(F.array_max(w), 4).alias("w_max"),
        F.round(F.aggregate(F.transform(w, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v) / 465, 1).alias("w_weighted"),
    ]


def window_shape_sql(w: str = "w") -> str:
    return f"""round({w}[1], 4) AS w_first, round({w}[10], 4) AS w_10, round({w}[20], 4) AS w_20,
    round({w}[-1], 4) AS w_last, CAST(len({w}) AS INTEGER) AS w_size,
    round(list_min({w}), 4) AS w_min, round(list_max({w}), 4) AS w_max,
    round(list_sum(list_transform({w}, lambda v, i: v * i)) / 465, 1) AS w_weighted"""


@query("bars_daily", sql=using("bars", select="SELECT symbol, day, high, low FROM bars"))
def bars_daily(spark, folder):
    return item_bars(spark, folder)


@query(
    "unplaced_rows",
    sql=using(
        "bars",
        select="""SELECT CASE WHEN k IS NULL AND d IS NULL THEN 'symbol,day' WHEN k IS NULL THEN 'symbol' ELSE 'day' END AS lacking, count(*) AS n_rows
    FROM (SELECT CASE WHEN day(day) <> 13 THEN symbol END AS k, CASE WHEN month(day) <> 5 THEN day END AS d FROM bars) WHERE k IS NULL OR d IS NULL GROUP BY 1""",
    ),
)
def unplaced(spark, folder):
    """Bars whose symbol or day got lost, which no series can hold."""
    bars = item_bars(spark, folder)
    lost = bars.select(F.when(F.day("day") != 13, F.col("symbol")).alias("symbol"), F.when(F.month("day") != 5, F.col("day")).alias("day"))
    return unplaced_rows(lost, ["symbol"], "day")


@query(
    "bars_hourly",
    sql="""SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, max(value) AS high, min(value) AS low
    FROM events GROUP BY 1, 2""",
)
def bars_hourly(spark, folder):
    return event_bars(spark, folder)


@query(
    "bars_joint_drop",
    sql="""SELECT * FROM (
    SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day,
    max(CASE WHEN l_quantity >= 40 THEN l_extendedprice END) AS high,
    min(CASE WHEN l_quantity <= 10 THEN l_extendedprice END) AS low
    FROM lineitem GROUP BY 1, 2) WHERE high IS NOT NULL AND low IS NOT NULL""",
)
def bars_joint_drop(spark, folder):
    items = table(spark, folder, "lineitem")
    gaps = items.groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(
        F.max(F.when(F.col("l_quantity") >= 40, F.col("l_extendedprice"))).alias("high"),
        F.min(F.when(F.col("l_quantity") <= 10, F.col("l_extendedprice"))).alias("low"),
    )
    return complete_bars(gaps)


@query("series_unpivot", sql=using("series", select="SELECT series_id, day, x FROM series"))
def series_unpivot(spark, folder):
    clean = complete_bars(item_bars(spark, folder))
    long = clean.select("symbol", "day", F.expr("stack(2, 'High', high, 'Low', low) AS (which, x)"))
    return long.select(F.concat_ws("_", "symbol", "which").alias("series_id"), "day", "x")


@query(
    "series_index",
    sql=using(
        "orders_bars",
        select="""SELECT series_id, day, x,
    CAST(row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS INTEGER) AS idx,
    CAST(count(*) OVER (PARTITION BY series_id) AS INTEGER) AS n
    FROM (SELECT symbol || '_High' AS series_id, day, high AS x FROM orders_bars
          UNION ALL SELECT symbol || '_Low', day, low FROM orders_bars)""",
    ),
)
def series_index(spark, folder):
    return series_from_bars(order_bars(spark, folder)).drop("train_end")


@query(
    "split_train_test",
    sql=using(
        "series",
        select="""SELECT series_id, idx, CASE WHEN idx < train_end THEN 'train' ELSE 'test' END AS split, n, train_end
    FROM series WHERE idx >= 30""",
    ),
)
def split_train_test(spark, folder):
    return with_split(item_series(spark, folder)).select("series_id", "idx", "split", "n", "train_end")


@query(
    "sliding_windows",
    sql=using(
        "win",
        select=f"""SELECT series_id, idx, y, CASE WHEN idx < train_end THEN 'train' ELSE 'test' END AS split,
    {window_shape_sql()} FROM win""",
    ),
)
def sliding_windows_q(spark, folder):
    return sliding_windows(item_series(spark, folder)).select("series_id", "idx", "y", "split", *window_shape())


@query(
    "history_expand",
    sql=using(
        "walk",
        select="""SELECT o.series_id, o.idx AS origin, CAST(count(*) AS INTEGER) AS hist_rows,
    sum(h.x) AS hist_sum, round(avg(h.x), 4) AS hist_mean, min(h.x) AS hist_min, max(h.x) AS hist_max
    FROM walk o JOIN walk h ON h.series_id = o.series_id AND h.idx < o.idx
    WHERE o.idx >= o.train_end GROUP BY 1, 2""",
    ),
)
def history_expand(spark, folder):
    return history_summary(walk(spark, folder)).withColumn("hist_mean", F.round("hist_mean", 4))


@query(
    "history_even_slice",
    sql=using(
        "walk",
        select="""SELECT o.series_id, o.idx AS origin, min(h.idx) AS first_idx,
    CAST(count(*) AS INTEGER) AS hist_rows, sum(h.x) AS hist_sum
    FROM walk o JOIN walk h ON h.series_id = o.series_id AND h.idx < o.idx AND h.idx >= o.idx % 2
    WHERE o.idx >= o.train_end GROUP BY 1, 2""",
    ),
)
def history_even_slice(spark, folder):
    return even_history_summary(walk(spark, folder))


@query(
    "origin_tail",
    sql=using(
        "series",
        select="""SELECT o.series_id, o.idx AS origin, h.idx, CAST(h.idx - o.idx + 30 AS INTEGER) AS pos, h.x
    FROM series o JOIN series h ON h.series_id = o.series_id AND h.idx < o.idx AND h.idx >= o.idx - 30
    WHERE o.idx >= o.train_end""",
    ),
)
def origin_tail_q(spark, folder):
    return origin_tail(item_series(spark, folder))


@query(
    "refit_stride",
    sql=using(
        "win",
        select=f"""SELECT t.series_id, t.idx, t.y, r.idx AS refit_idx, {window_shape_sql("r.w")}
    FROM win t JOIN win r ON r.series_id = t.series_id
     AND r.idx = t.train_end + {STRIDE} * ((t.idx - t.train_end) // {STRIDE})
    WHERE t.idx >= t.train_end""",
    ),
)
def refit_stride(spark, folder):
    served = refit_windows(sliding_windows(item_series(spark, folder)), STRIDE)
    return served.select("series_id", "idx", "y", "refit_idx", *window_shape())


@query(
    "trace_first_n",
    sql=using(
        "walk",
        select="""SELECT series_id, idx, x, persistence FROM (
    SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY idx) AS persistence,
    row_number() OVER (PARTITION BY series_id, idx >= train_end ORDER BY idx) AS k FROM walk)
    WHERE idx >= train_end AND k <= 100""",
    ),
)
def trace_first_n(spark, folder):
    rows = spread(walk(spark, folder), before=1)
    rows = at_home(rows.withColumn("persistence", F.lag("x").over(lane())))
    return trace_rows(rows).select("series_id", "idx", "x", "persistence")


@query(
    "synthetic_series",
    sql=using(
        "series",
        select="""SELECT series_id, idx, round(10 * sin(2 * pi() * idx / 9), 6) + CAST(0 AS DOUBLE) AS fast,
    round(30 * sin(2 * pi() * idx / 40), 6) + CAST(0 AS DOUBLE) AS slow, 5000 + CAST(0.5 AS DOUBLE) * idx AS trend,
    round(10 * sin(2 * pi() * idx / 9) + 30 * sin(2 * pi() * idx / 40) + 5000 + CAST(0.5 AS DOUBLE) * idx, 6) AS x
    FROM series""",
    ),
)
def synthetic_series(spark, folder):
    made = synthetic_components(item_series(spark, folder))
    return made.select(
        "series_id", "idx", "trend", *[F.round(c, 6).alias(c) for c in ("fast", "slow", "x")]
    )


@query(
    "index_gaps",
    sql=using(
        "orders_bars",
        select="""SELECT symbol, CAST(count(*) AS BIGINT) AS n_days,
    CAST(date_diff('day', min(day), max(day)) + 1 AS INTEGER) AS span_days,
    count(*) FILTER (WHERE gap > 1) AS n_gaps, CAST(coalesce(max(gap), 1) AS INTEGER) AS longest_step,
    coalesce(max(gap), 1) = 1 AS is_contiguous
    FROM (SELECT symbol, day, date_diff('day', lag(day) OVER (PARTITION BY symbol ORDER BY day), day) AS gap
          FROM orders_bars) GROUP BY 1""",
    ),
)
def index_gaps(spark, folder):
    from tidewatch.operators.quality import calendar_gaps

    return calendar_gaps(order_bars(spark, folder))
