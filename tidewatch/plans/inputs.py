"""The series every query starts from, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.centred import HALF_WIDTHS
from tidewatch.operators.forecast import assemble, complete, component_forecasts
from tidewatch.operators.protocols import full_series_windows, walk_forward_windows
from tidewatch.plans.registry import fragment
from tidewatch.sources.bars import bars, series_from_bars, walk_from_bars
from tidewatch.sources.tables import remembered, table


def item_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars(table(spark, folder, "lineitem"), "l_returnflag", "l_shipdate", "l_extendedprice")


def order_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars(table(spark, folder, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


def event_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars(table(spark, folder, "events"), "event_type", "ts", "value", grain="hour")


def item_series(spark: SparkSession, folder: str) -> DataFrame:
    return series_from_bars(item_bars(spark, folder))


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """Random-walk-like level series, built once per session."""
    return remembered(spark, folder, "walk", lambda s, f: walk_from_bars(item_bars(s, f)))


fragment(
    "bars",
    sql="""SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low FROM lineitem GROUP BY 1, 2""",
)
fragment(
    "orders_bars",
    sql="""SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day,
    max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders GROUP BY 1, 2""",
)
fragment(
    "series",
    "bars",
    sql="""SELECT series_id, day, x,
    CAST(row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS INTEGER) AS idx,
    CAST(count(*) OVER (PARTITION BY series_id) AS INTEGER) AS n,
    30 + CAST(floor(0.8 * (count(*) OVER (PARTITION BY series_id) - 30)) AS INTEGER) AS train_end
    FROM (SELECT symbol || '_High' AS series_id, day, high AS x FROM bars
          UNION ALL SELECT symbol || '_Low', day, low FROM bars)""",
)
fragment(
    "walk",
    "series",
    sql="""SELECT series_id, day, idx, n, train_end,
    CAST(1e8 AS DOUBLE) + sum(cents - step) OVER (PARTITION BY series_id ORDER BY idx
         ROWS UNBOUNDED PRECEDING) AS x
    FROM (SELECT *, round(x * 100) AS cents,
          round(avg(round(x * 100)) OVER (PARTITION BY series_id)) AS step FROM series)""",
)


def both_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Component windows of both protocols; the full-series one ends and splits one row earlier."""
    rows = walk(spark, folder)
    return full_series_windows(rows, trim_newest=1).unionByName(walk_forward_windows(rows))


def delivered_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Walk-forward windows with the known fault of odd-length histories."""
    return walk_forward_windows(walk(spark, folder), trim_end_to_even=True)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Component forecasts of two linear models under both protocols."""
    return component_forecasts(both_windows(spark, folder))


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Assembled forecasts, training rows included; built once per session."""
    return remembered(spark, folder, "forecasts", lambda s, f: complete(assemble(parts(s, f), COMPONENTS)))


def _levels(source: str, keep: str) -> str:
    means = ", ".join(
        f"avg(x) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS l{h}"
        for h in HALF_WIDTHS
    )
    return f"SELECT series_id, idx, n, x, train_end, {means} FROM {source} WHERE {keep}"


COMPONENTS = len(HALF_WIDTHS) + 1
COMP_LIST = "[x - l1, l1 - l2, l2 - l4, l4 - l8, l8 - l16, l16]"
WINDOW_OF = "list(c) OVER (PARTITION BY series_id, comp ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"

fragment("levels", "walk", sql=_levels("walk", "true"))
fragment(
    "comps",
    "levels",
    sql=f"SELECT series_id, idx, n, train_end, x, unnest(range({COMPONENTS})) AS comp, unnest({COMP_LIST}) AS c FROM levels",
)
for _name, _keep, _start in (("full", "idx < n - 1", "train_end - 1"), ("early", "idx < train_end", "train_end")):
    fragment(f"levels_{_name}", "walk", sql=_levels("walk", _keep))
    fragment(
        f"comps_{_name}",
        f"levels_{_name}",
        sql=f"""SELECT series_id, idx, n, x, {_start} AS test_start, unnest(range({COMPONENTS})) AS comp,
        unnest({COMP_LIST}) AS c FROM levels_{_name}""",
    )
# Every history that ends at row e in the test part, its last 30 rows s, levels by brute force.
fragment(
    "tails",
    "walk",
    sql=f"""SELECT e.series_id, e.idx AS e, s.idx AS s, any_value(s.x) AS x, any_value(e.train_end) AS train_end,
    any_value(e.n) AS n, {", ".join(f"avg(CASE WHEN abs(q.idx - s.idx) <= {h} THEN q.x END) AS l{h}" for h in HALF_WIDTHS)}
    FROM walk e JOIN walk s ON s.series_id = e.series_id AND s.idx BETWEEN e.idx - 29 AND e.idx
    JOIN walk q ON q.series_id = s.series_id AND q.idx BETWEEN s.idx - 16 AND s.idx + 16 AND q.idx <= e.idx
    WHERE e.idx >= e.train_end - 2 GROUP BY 1, 2, 3""",
)
fragment(
    "tail_comps",
    "tails",
    sql=f"""SELECT series_id, e, s, n, train_end, x, unnest(range({COMPONENTS})) AS comp, unnest({COMP_LIST}) AS c
    FROM tails""",
)
fragment(
    "walk_test",
    "tail_comps",
    sql="""SELECT f.series_id, f.comp, f.t AS idx, f.w, y.c AS y, y.x, y.n, y.train_end AS test_start FROM
    (SELECT series_id, comp, e + 1 AS t, list(c ORDER BY s) AS w FROM tail_comps GROUP BY 1, 2, 3) f
    JOIN tail_comps y ON y.series_id = f.series_id AND y.comp = f.comp AND y.e = f.t AND y.s = f.t
    WHERE f.t >= y.train_end""",
)
fragment(
    "walk_delivered",
    "tail_comps",
    "walk",
    sql="""SELECT r.series_id, CAST(f.comp AS INTEGER) AS comp, r.idx, f.w, y.c AS y, r.x, r.n, r.train_end AS test_start
    FROM walk r JOIN (SELECT series_id, comp, e, list(c ORDER BY s) AS w FROM tail_comps GROUP BY 1, 2, 3) f
      ON f.series_id = r.series_id AND f.e = r.idx - 1 - r.idx % 2
    JOIN tail_comps y ON y.series_id = r.series_id AND y.comp = f.comp AND y.e = r.idx - (r.idx + 1) % 2 AND y.s = y.e
    WHERE r.idx >= r.train_end""",
)
fragment(
    "wins",
    "comps_full",
    "comps_early",
    "walk_test",
    sql=f"""SELECT 'full_series' AS protocol, series_id, CAST(comp AS INTEGER) AS comp, idx,
    CASE WHEN idx < test_start THEN 'train' ELSE 'test' END AS split, w, c AS y, x, n, test_start
    FROM (SELECT *, {WINDOW_OF} AS w FROM comps_full) WHERE idx >= 30
    UNION ALL SELECT 'walk_forward', series_id, CAST(comp AS INTEGER), idx, 'train', w, c, x, n, test_start
    FROM (SELECT *, {WINDOW_OF} AS w FROM comps_early) WHERE idx >= 30
    UNION ALL SELECT 'walk_forward', series_id, CAST(comp AS INTEGER), idx, 'test', w, y, x, n, test_start FROM walk_test""",
)
fragment(
    "scales",
    "wins",
    sql="""SELECT * FROM (SELECT series_id, protocol, comp, stddev_pop(dev) AS s_in FROM
      (SELECT series_id, protocol, comp, unnest(list_transform(w, lambda v: v - w[-1])) AS dev FROM wins WHERE split = 'train')
      GROUP BY 1, 2, 3)
    JOIN (SELECT series_id, protocol, comp, stddev_pop(y - w[-1]) AS s_out, min(least(list_min(w), y)) AS low,
      max(greatest(list_max(w), y)) AS high, min(y) AS y_low, max(y) AS y_high FROM wins WHERE split = 'train' GROUP BY 1, 2, 3)
    USING (series_id, protocol, comp)""",
)
fragment(
    "scaled",
    "wins",
    "scales",
    sql="""SELECT *, (y - w[-1]) / s_out AS ty, (w[-2] - w[-1]) / s_in AS f1, (w[-3] - w[-1]) / s_in AS f2
    FROM wins JOIN scales USING (series_id, protocol, comp)""",
)
fragment(
    "coefs",
    "scaled",
    sql="""SELECT series_id, protocol, comp, regr_slope(ty, f1) AS a1, regr_intercept(ty, f1) AS a0,
    b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (
    SELECT series_id, protocol, comp, ty, f1, avg(ty) OVER g AS my, avg(f1) OVER g AS m1, avg(f2) OVER g AS m2,
    (covar_pop(ty, f1) OVER g * var_pop(f2) OVER g - covar_pop(ty, f2) OVER g * covar_pop(f1, f2) OVER g)
      / (var_pop(f1) OVER g * var_pop(f2) OVER g - covar_pop(f1, f2) OVER g ** 2) AS b1,
    (covar_pop(ty, f2) OVER g * var_pop(f1) OVER g - covar_pop(ty, f1) OVER g * covar_pop(f1, f2) OVER g)
      / (var_pop(f1) OVER g * var_pop(f2) OVER g - covar_pop(f1, f2) OVER g ** 2) AS b2
    FROM scaled WHERE split = 'train' WINDOW g AS (PARTITION BY series_id, protocol, comp))
    GROUP BY 1, 2, 3, b1, b2, my, m1, m2""",
)
fragment(
    "parts",
    "scaled",
    "coefs",
    sql="""SELECT series_id, protocol, comp, idx, split, test_start, x, y, w[-1] AS last, unnest(['lag1', 'lag2']) AS model,
    unnest([w[-1] + s_out * (a0 + a1 * f1), w[-1] + s_out * (b0 + b1 * f1 + b2 * f2)]) AS p
    FROM scaled JOIN coefs USING (series_id, protocol, comp)""",
)
fragment(
    "fc",
    "parts",
    sql="""SELECT series_id, protocol, model, idx, split, test_start, max(x) AS y, sum(p) AS y_pred, sum(last) AS input_last
    FROM parts GROUP BY ALL""",
)
