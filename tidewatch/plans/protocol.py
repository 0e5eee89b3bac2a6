"""Decomposition, component windows and component forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.blocks import at_home, lane, spread, with_totals
from tidewatch.operators.centred import HALF_WIDTHS, decompose_centred, long_components
from tidewatch.operators.forecast import assemble, assembly_gaps, bias_corrected
from tidewatch.operators.protocols import full_series_windows, walk_forward_windows
from tidewatch.operators.scaling import once, out_of_range_share, scale_windows, unscale
from tidewatch.operators.scoring import score
from tidewatch.plans.inputs import COMPONENTS, both_windows, forecasts, parts, walk
from tidewatch.plans.prepared import window_shape, window_shape_sql
from tidewatch.plans.registry import query, using
from tidewatch.plans.scored import METRICS_SQL, rounded


def _shaped(windows):
    return windows.select(
        "series_id", "comp", "idx", "split", F.round("y", 4).alias("y"), "x", *window_shape()
    )


@query(
    "protocol_full_series",
    sql=using(
        "wins",
        select=f"""SELECT series_id, comp, idx, split, round(y, 4) AS y, x, {window_shape_sql()}
    FROM wins WHERE protocol = 'full_series'""",
    ),
)
def protocol_full_series(spark, folder):
    return _shaped(full_series_windows(walk(spark, folder), trim_newest=1))


@query(
    "protocol_walk_forward",
    sql=using(
        "wins",
        select=f"""SELECT series_id, comp, idx, split, round(y, 4) AS y, x, {window_shape_sql()}
    FROM wins WHERE protocol = 'walk_forward'""",
    ),
)
def protocol_walk_forward(spark, folder):
    return _shaped(walk_forward_windows(walk(spark, folder)))


STRIDES = (1, 5, 20)


@query(
    "protocol_walk_forward_stride",
    sql=using(
        "walk_test",
        select=f"""SELECT t.series_id, CAST(t.comp AS INTEGER) AS comp, t.idx, CAST(s.stride AS INTEGER) AS stride, round(t.y, 4) AS y, t.x, {window_shape_sql("r.w")}
    FROM walk_test t, (VALUES {", ".join(f"({k})" for k in STRIDES)}) s(stride)
    JOIN walk_test r ON r.series_id = t.series_id AND r.comp = t.comp AND r.idx = t.test_start + s.stride * ((t.idx - t.test_start) // s.stride)""",
    ),
)
def protocol_walk_forward_stride(spark, folder):
    """Test windows with a refit at every row, every fifth and every twentieth."""
    rows = walk(spark, folder)
    made = [walk_forward_windows(rows, stride=k).where(F.col("split") == "test").withColumn("stride", F.lit(k)) for k in STRIDES]
    every = made[0].unionByName(made[1]).unionByName(made[2])
    return every.select("series_id", "comp", "idx", "stride", F.round("y", 4).alias("y"), "x", *window_shape())


@query(
    "recon_error",
    sql=using(
        "comps",
        select="""SELECT series_id, round(max(abs(total - x)), 4) + 0.0 AS recon_max_err,
    round(100 * max(abs(total - x)) / nullif(max(x) - min(x), 0), 6) + 0.0 AS recon_pct_of_range,
    CAST(max(k) AS BIGINT) AS n_components
    FROM (SELECT series_id, idx, any_value(x) AS x, sum(c) AS total, count(*) AS k FROM comps GROUP BY 1, 2) GROUP BY 1""",
    ).replace("+ 0.0", "+ CAST(0 AS DOUBLE)"),
)
def recon_error(spark, folder):
    from tidewatch.operators.quality import reconstruction_error

    return rounded(reconstruction_error(decompose_centred(walk(spark, folder)), COMPONENTS), recon_pct_of_range=6)


@query(
    "zero_crossings",
    sql=using(
        "comps",
        select="""SELECT series_id, CAST(comp AS INTEGER) AS comp, count(*) FILTER (WHERE s <> prev) AS crossings FROM (
    SELECT *, lag(s) OVER (PARTITION BY series_id, comp ORDER BY idx) AS prev FROM (
    SELECT series_id, comp, idx, sign(c - avg(c) OVER (PARTITION BY series_id, comp)) AS s FROM comps)) GROUP BY 1, 2""",
    ),
)
def zero_crossings(spark, folder):
    from tidewatch.operators.quality import zero_crossings as crossings

    return crossings(decompose_centred(walk(spark, folder)), COMPONENTS)


@query(
    "run_spread",
    sql=using(
        "levels",
        select="""SELECT series_id, round(max(abs(d)), 4) AS max_abs_diff,
    round(100 * max(abs(d)) / (max(x) - min(x)), 6) AS pct_of_range FROM (
    SELECT series_id, x, unnest([l1 - avg(x) OVER (p ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
      (l1 - l2) - (avg(x) OVER (p ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - avg(x) OVER (p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
      l2 - avg(x) OVER (p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)]) AS d
    FROM levels WINDOW p AS (PARTITION BY series_id ORDER BY idx)) GROUP BY 1""",
    ),
)
def run_spread(spark, folder):
    from tidewatch.operators.quality import run_spread as spread_of

    rows = walk(spark, folder)
    first = long_components(decompose_centred(rows, (1, 2)), 3)
    second = long_components(decompose_centred(rows, (2, 3)), 3)
    return rounded(spread_of(rows, first, second), pct_of_range=6)


@query(
    "sweep_argmin",
    sql=using(
        "levels_early",
        select="""SELECT series_id, arg_min(half_width, mse) AS half_width, round(sqrt(min(mse)), 2) AS rmse FROM (
    SELECT series_id, unnest([1, 2, 4, 8, 16]) AS half_width,
    unnest([avg((x - l1) ** 2), avg((x - l2) ** 2), avg((x - l4) ** 2), avg((x - l8) ** 2), avg((x - l16) ** 2)]) AS mse
    FROM levels_early GROUP BY series_id) GROUP BY 1""",
    ),
)
def sweep_argmin(spark, folder):
    from tidewatch.operators.sweep import sweep_half_widths

    best = sweep_half_widths(walk(spark, folder), HALF_WIDTHS)
    return best.select("series_id", "half_width", F.round(F.sqrt("mse"), 2).alias("rmse"))


@query(
    "scale_last_value",
    sql=using(
        "scaled",
        select="""SELECT series_id, protocol, comp, split, n, s_in, s_out, sw_mean, sw_std, sy_mean, sy_std FROM (
    SELECT series_id, protocol, comp, split, count(*) AS n, round(any_value(s_in), 2) AS s_in,
    round(any_value(s_out), 2) AS s_out, round(avg(ty), 6) AS sy_mean, round(stddev_pop(ty), 6) AS sy_std
    FROM scaled GROUP BY 1, 2, 3, 4) JOIN (
    SELECT series_id, protocol, comp, split, round(avg(v), 6) AS sw_mean, round(stddev_pop(v), 6) AS sw_std FROM (
    SELECT series_id, protocol, comp, split, unnest(list_transform(w, lambda v: (v - w[-1]) / s_in)) AS v FROM scaled)
    GROUP BY 1, 2, 3, 4) USING (series_id, protocol, comp, split)""",
    ),
)
def scale_last_value(spark, folder):
    return _scale_summary(scale_windows(both_windows(spark, folder)), ["s_in", "s_out"], 2)


def _scale_summary(scaled, scale_columns, digits):
    """Mean and deviation of scaled inputs and targets; elements are combined before the shuffle."""
    elements = scaled.select("series_id", "protocol", "comp", "split", "sy", *scale_columns, F.posexplode("sw").alias("pos", "v"))
    return elements.groupBy("series_id", "protocol", "comp", "split").agg(
        F.count_if(F.col("pos") == 0).alias("n"),
        *[F.round(F.max(c), digits).alias(c) for c in scale_columns],
        F.round(F.avg("v"), 6).alias("sw_mean"),
        F.round(F.stddev_pop("v"), 6).alias("sw_std"),
        F.round(F.avg(once(F.col("sy"))), 6).alias("sy_mean"),
        F.round(F.stddev_pop(once(F.col("sy"))), 6).alias("sy_std"),
    )


@query(
    "scale_minmax",
    sql=using(
        "scaled",
        select="""SELECT series_id, protocol, comp, split, n, low, width, sw_mean, sw_std, sy_mean, sy_std FROM (
    SELECT series_id, protocol, comp, split, count(*) AS n, round(any_value(low), 2) AS low,
    round(any_value(high - low), 2) AS width, round(avg((y - low) / (high - low)), 6) AS sy_mean,
    round(stddev_pop((y - low) / (high - low)), 6) AS sy_std
    FROM scaled GROUP BY 1, 2, 3, 4) JOIN (
    SELECT series_id, protocol, comp, split, round(avg(v), 6) AS sw_mean, round(stddev_pop(v), 6) AS sw_std FROM (
    SELECT series_id, protocol, comp, split, unnest(list_transform(w, lambda v: (v - low) / (high - low))) AS v FROM scaled)
    GROUP BY 1, 2, 3, 4) USING (series_id, protocol, comp, split)""",
    ),
)
def scale_minmax(spark, folder):
    return _scale_summary(scale_windows(both_windows(spark, folder), "minmax"), ["low", "width"], 2)


@query(
    "unscale_forecast",
    sql=using(
        "scaled",
        select="""SELECT series_id, protocol, comp, idx, round(w[-1] + s_out * f1, 2) AS p
    FROM scaled WHERE split = 'test'""",
    ),
)
def unscale_forecast(spark, folder):
    scaled = scale_windows(both_windows(spark, folder)).where(F.col("split") == "test")
    guess = scaled.withColumn("guess", F.element_at("sw", -2))
    return guess.select("series_id", "protocol", "comp", "idx", F.round(unscale("guess"), 2).alias("p"))


@query(
    "out_of_range_share",
    sql=using(
        "scaled",
        select="""SELECT series_id, protocol, comp, count(*) AS n,
    round(avg(CASE WHEN y < y_low OR y > y_high THEN 1 ELSE 0 END), 6) AS share
    FROM scaled WHERE split = 'test' GROUP BY 1, 2, 3""",
    ),
)
def out_of_range(spark, folder):
    return rounded(out_of_range_share(both_windows(spark, folder)), 6)


@query(
    "component_linear_forecast",
    sql=using(
        "parts",
        select="""SELECT series_id, protocol, comp, model, idx, round(p, 2) AS p FROM parts WHERE split = 'test'""",
    ),
)
def component_linear_forecast(spark, folder):
    rows = parts(spark, folder).where(F.col("split") == "test")
    return rows.select("series_id", "protocol", "comp", "model", "idx", F.round("p", 2).alias("p"))


@query(
    "assemble_forecast",
    sql=using(
        "fc",
        select="""SELECT series_id, protocol, model, idx, y, round(y_pred, 2) AS y_pred FROM fc WHERE split = 'test'""",
    ),
)
def assemble_forecast(spark, folder):
    rows = forecasts(spark, folder).where(F.col("split") == "test")
    return rows.select("series_id", "protocol", "model", "idx", "y", F.round("y_pred", 2).alias("y_pred"))


def some_parts_lost(spark, folder):
    """Component forecasts without the third component of every seventh row."""
    return parts(spark, folder).where((F.col("comp") != 2) | (F.col("idx") % 7 != 0))


@query(
    "assembly_gaps",
    sql=using(
        "parts",
        select=f"""SELECT series_id, protocol, model, count(*) AS n_rows, count(*) FILTER (WHERE k < {COMPONENTS}) AS n_incomplete, min(k) AS fewest_parts
    FROM (SELECT series_id, protocol, model, idx, count(*) AS k FROM parts WHERE comp <> 2 OR idx % 7 <> 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
    ),
)
def assembly_gaps_q(spark, folder):
    return assembly_gaps(assemble(some_parts_lost(spark, folder), COMPONENTS))


@query(
    "fc_input_persistence",
    sql=using(
        "fc",
        select=f"""SELECT series_id, protocol, count(*) AS n, {METRICS_SQL.replace("y_pred", "input_last")}
    FROM fc WHERE split = 'test' AND model = 'lag1' GROUP BY 1, 2""",
    ),
)
def fc_input_persistence(spark, folder):
    rows = forecasts(spark, folder).where((F.col("split") == "test") & (F.col("model") == "lag1"))
    return rounded(score(rows, ["series_id", "protocol"], pred="input_last"), r2=6)


@query(
    "bias_correct",
    sql=using(
        "fc",
        select="""SELECT series_id, protocol, model, count(*) AS n, round(any_value(a), 6) AS a,
    round(sqrt(avg((y - y_pred) ** 2)), 2) AS rmse, round(sqrt(avg((y - a * y_pred - b) ** 2)), 2) AS rmse_corrected
    FROM fc JOIN (SELECT series_id, protocol, model, regr_slope(y, y_pred) AS a, regr_intercept(y, y_pred) AS b FROM fc
      WHERE split = 'train' AND idx >= test_start - greatest(10, CAST(floor(0.1 * (test_start - 30)) AS INTEGER)) GROUP BY 1, 2, 3)
    USING (series_id, protocol, model) WHERE split = 'test' GROUP BY 1, 2, 3""",
    ),
)
def bias_correct(spark, folder):
    fixed = bias_corrected(forecasts(spark, folder))
    e, c = F.col("y") - F.col("y_pred"), F.col("y") - F.col("y_corrected")
    return fixed.groupBy("series_id", "protocol", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.max("a"), 6).alias("a"),
        F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
        F.round(F.sqrt(F.avg(c * c)), 2).alias("rmse_corrected"),
    )
