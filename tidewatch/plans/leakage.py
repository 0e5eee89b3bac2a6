"""Protocol comparison and leakage diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.baselines import benchmark_forecasts
from tidewatch.operators.blocks import at_home, lane, spread
from tidewatch.operators.diagnostics import (
    boundary_amplitude,
    change_correlation,
    diagnostic_features,
    on_common_dates,
    two_fold_skill,
)
from tidewatch.operators.forecast import MODELS
from tidewatch.operators.scoring import (
    accuracy_table,
    common_dates,
    comparison_table,
    component_scores,
    dm_pairwise,
    leakage_inflation,
    protocol_pairs,
    study_summary,
    worst_rows,
)
from tidewatch.plans.inputs import both_windows, forecasts, parts, walk
from tidewatch.plans.registry import fragment, query, using
from tidewatch.plans.scored import METRICS_SQL, p_value_sql, rounded
from tidewatch.sources.tables import remembered

fragment("fc_test", "fc", sql="SELECT * FROM fc WHERE split = 'test'")
fragment(
    "fc_wide",
    "fc_test",
    sql="""SELECT series_id, idx, max(y) AS y,
    max(CASE WHEN protocol = 'full_series' AND model = 'lag1' THEN y_pred END) AS full_lag1,
    max(CASE WHEN protocol = 'full_series' AND model = 'lag2' THEN y_pred END) AS full_lag2,
    max(CASE WHEN protocol = 'walk_forward' AND model = 'lag1' THEN y_pred END) AS walk_lag1,
    max(CASE WHEN protocol = 'walk_forward' AND model = 'lag2' THEN y_pred END) AS walk_lag2
    FROM fc_test GROUP BY 1, 2 HAVING count(*) = 4""",
)


def dm_sql(d: str = "d") -> str:
    return (
        f"CASE WHEN var_pop({d}) > 0 THEN avg({d}) / sqrt(var_pop({d}) / count(*)) * sqrt((count(*) - 1.0) / count(*)) END"
    )


def test_forecasts(spark, folder):
    return forecasts(spark, folder).where(F.col("split") == "test")


def protocol_baselines(spark, folder):
    """Benchmarks of both protocols' test rows; each protocol starts where its own test part does."""
    rows = walk(spark, folder)
    full = benchmark_forecasts(rows.withColumn("start", F.col("train_end") - 1), "start")
    later = benchmark_forecasts(rows)
    return full.withColumn("protocol", F.lit("full_series")).unionByName(
        later.withColumn("protocol", F.lit("walk_forward"))
    )


fragment(
    "walk_lagged",
    "walk",
    sql="""SELECT *, lag(x) OVER o AS persistence,
    avg(x) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ma5,
    avg(x) OVER (o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ma20,
    avg(x) OVER (o ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean10,
    first_value(x) OVER o AS x0
    FROM (SELECT p.protocol, w.*, train_end - p.earlier AS start FROM walk w,
          (VALUES ('full_series', 1), ('walk_forward', 0)) p(protocol, earlier))
    WINDOW o AS (PARTITION BY protocol, series_id ORDER BY idx)""",
)
fragment(
    "walk_base",
    "walk_lagged",
    sql="""SELECT protocol, series_id, idx, x AS y, persistence,
    persistence + (first_value(persistence) OVER t - x0) / greatest(start - 1, 1) AS drift, ma5, ma20,
    list_reduce(list(persistence) OVER t, lambda acc, v: (2.0 / 11) * v + (1 - 2.0 / 11) * acc,
                first_value(mean10) OVER t) AS ewma10
    FROM walk_lagged WHERE idx >= start
    WINDOW t AS (PARTITION BY protocol, series_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
)


@query(
    "comparison_table",
    sql=using(
        "fc_test",
        "walk_base",
        select=f"""SELECT *, coalesce(abs(dm) > 1.96, false) AS sig_196, coalesce(p < 0.05, false) AS sig_p05,
    dm > 0 AS model_worse FROM (
    SELECT series_id, protocol, model, baseline, round(dm, 4) AS dm, round({p_value_sql("dm", "(t - 1)")}, 6) AS p FROM (
    SELECT series_id, protocol, model, baseline, count(*) AS t, {dm_sql()} AS dm FROM (
    SELECT f.series_id, f.protocol, f.model, b.baseline, (f.y - f.y_pred) ** 2 - (f.y - b.b_pred) ** 2 AS d
    FROM fc_test f JOIN (SELECT protocol, series_id, idx,
      unnest(['Persistence', 'Drift', 'MA-5', 'MA-20', 'EWMA-10']) AS baseline,
      unnest([persistence, drift, ma5, ma20, ewma10]) AS b_pred FROM walk_base) b
    USING (series_id, protocol, idx)) GROUP BY 1, 2, 3, 4))""",
    ),
)
def comparison_table_q(spark, folder):
    return rounded(comparison_table(test_forecasts(spark, folder), protocol_baselines(spark, folder)), p=6)


@query(
    "leakage_inflation",
    sql=using(
        "fc_test",
        select="""SELECT series_id, model, count(*) FILTER (WHERE k = 2) AS common_dates,
    count(*) FILTER (WHERE k = 1 AND a IS NOT NULL) AS full_only, count(*) FILTER (WHERE k = 1 AND b IS NOT NULL) AS walk_only,
    round(sqrt(avg(CASE WHEN k = 2 THEN (y - a) ** 2 END)), 2) AS rmse_full,
    round(sqrt(avg(CASE WHEN k = 2 THEN (y - b) ** 2 END)), 2) AS rmse_walk,
    round(avg(CASE WHEN k = 2 THEN abs((y - a) / y) END) * 100, 6) AS mape_full,
    round(avg(CASE WHEN k = 2 THEN abs((y - b) / y) END) * 100, 6) AS mape_walk,
    round(sqrt(avg(CASE WHEN k = 2 THEN (y - b) ** 2 END)) / sqrt(avg(CASE WHEN k = 2 THEN (y - a) ** 2 END)), 6) AS inflation_ratio
    FROM (SELECT series_id, model, idx, max(y) AS y, count(*) AS k, max(CASE WHEN protocol = 'full_series' THEN y_pred END) AS a,
      max(CASE WHEN protocol = 'walk_forward' THEN y_pred END) AS b FROM fc_test GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ),
)
def leakage_inflation_q(spark, folder):
    found = leakage_inflation(test_forecasts(spark, folder))
    return rounded(found, 6, rmse_full=2, rmse_walk=2)


@query("common_dates", sql=using("fc_wide", select="SELECT series_id, idx, y FROM fc_wide"))
def common_dates_q(spark, folder):
    return common_dates(test_forecasts(spark, folder), list(MODELS)).select("series_id", "idx", "y")


@query(
    "protocol_overlap",
    sql=using(
        "fc_test",
        select="""SELECT coalesce(a.series_id, b.series_id) AS series_id, count(a.idx) AS n_full, count(b.idx) AS n_walk,
    min(a.idx) AS first_full, max(a.idx) AS last_full, min(b.idx) AS first_walk, max(b.idx) AS last_walk,
    count(*) FILTER (WHERE a.idx IS NOT NULL AND b.idx IS NOT NULL) AS common,
    count(*) FILTER (WHERE b.idx IS NULL) AS full_only, count(*) FILTER (WHERE a.idx IS NULL) AS walk_only
    FROM (SELECT * FROM fc_test WHERE protocol = 'full_series' AND model = 'lag1') a
    FULL JOIN (SELECT * FROM fc_test WHERE protocol = 'walk_forward' AND model = 'lag1') b USING (series_id, idx) GROUP BY 1""",
    ),
)
def protocol_overlap(spark, folder):
    pairs = protocol_pairs(test_forecasts(spark, folder).where(F.col("model") == "lag1"))
    full, walked = F.col("p_full").isNotNull(), F.col("p_walk").isNotNull()
    return pairs.groupBy("series_id").agg(
        F.count("p_full").alias("n_full"),
        F.count("p_walk").alias("n_walk"),
        F.min(F.when(full, F.col("idx"))).alias("first_full"),
        F.max(F.when(full, F.col("idx"))).alias("last_full"),
        F.min(F.when(walked, F.col("idx"))).alias("first_walk"),
        F.max(F.when(walked, F.col("idx"))).alias("last_walk"),
        F.count_if(full & walked).alias("common"),
        F.count_if(full & ~walked).alias("full_only"),
        F.count_if(~full & walked).alias("walk_only"),
    )


@query(
    "dm_pairwise",
    sql=using(
        "fc_wide",
        select=f"""SELECT series_id, pair, round(dm, 4) AS dm, round({p_value_sql("dm", "(t - 1)")}, 6) AS p FROM (
    SELECT series_id, pair, count(*) AS t, {dm_sql()} AS dm FROM (SELECT series_id,
      unnest(['walk_lag1 vs full_lag1', 'walk_lag2 vs full_lag2', 'full_lag1 vs full_lag2', 'walk_lag1 vs walk_lag2']) AS pair,
      unnest([(y - walk_lag1) ** 2 - (y - full_lag1) ** 2, (y - walk_lag2) ** 2 - (y - full_lag2) ** 2,
        (y - full_lag1) ** 2 - (y - full_lag2) ** 2, (y - walk_lag1) ** 2 - (y - walk_lag2) ** 2]) AS d
      FROM fc_wide) GROUP BY 1, 2)""",
    ),
)
def dm_pairwise_q(spark, folder):
    common = common_dates(test_forecasts(spark, folder), list(MODELS))
    pairs = [("walk_lag1", "full_lag1"), ("walk_lag2", "full_lag2"), ("full_lag1", "full_lag2"), ("walk_lag1", "walk_lag2")]
    return rounded(dm_pairwise(common, pairs), p=6)


def _summary_metrics(side: str, pred: str) -> str:
    return f"""avg(abs((y - {pred}) / y)) * 100 AS mape_{side},
      1 - sum((y - {pred}) ** 2) / (count(*) * var_pop(y)) AS r2_{side}, sqrt(avg((y - {pred}) ** 2)) AS rmse_{side}"""


fragment(
    "cases",
    "fc_wide",
    "walk",
    sql=f"""SELECT series_id, model, count(*) AS t, {_summary_metrics("full", "a")}, {_summary_metrics("walk", "b")},
    {dm_sql("(y - b) ** 2 - (y - a) ** 2")} AS dm_wa, {dm_sql("(y - a) ** 2 - (y - p) ** 2")} AS dm_ap,
    {dm_sql("(y - b) ** 2 - (y - p) ** 2")} AS dm_bp FROM (
    SELECT f.series_id, f.y, w.x AS p, unnest(['lag1', 'lag2']) AS model, unnest([full_lag1, full_lag2]) AS a,
      unnest([walk_lag1, walk_lag2]) AS b FROM fc_wide f JOIN walk w ON w.series_id = f.series_id AND w.idx = f.idx - 1)
    GROUP BY 1, 2""",
)


@query(
    "leakage_summary",
    sql=using(
        "cases",
        select=f"""SELECT count(*) AS n_cases, round(min(rmse_walk / rmse_full), 6) AS rho_min,
    round(max(rmse_walk / rmse_full), 6) AS rho_max, round(exp(avg(ln(rmse_walk / rmse_full))), 6) AS rho_geomean,
    count(*) FILTER (WHERE dm_wa > 0 AND {p_value_sql("dm_wa", "(t - 1)")} < 0.05) AS walk_significantly_worse,
    count(*) FILTER (WHERE dm_ap < 0 AND {p_value_sql("dm_ap", "(t - 1)")} < 0.05) AS full_beats_persistence,
    count(*) FILTER (WHERE dm_bp < 0 AND {p_value_sql("dm_bp", "(t - 1)")} < 0.05) AS walk_beats_persistence,
    count(*) FILTER (WHERE dm_ap > 0 AND {p_value_sql("dm_ap", "(t - 1)")} < 0.05) AS full_worse_than_persistence,
    count(*) FILTER (WHERE dm_bp > 0 AND {p_value_sql("dm_bp", "(t - 1)")} < 0.05) AS walk_worse_than_persistence,
    round(min(mape_full), 6) AS mape_full_min, round(max(mape_full), 6) AS mape_full_max,
    round(min(mape_walk), 6) AS mape_walk_min, round(max(mape_walk), 6) AS mape_walk_max,
    round(min(r2_full), 6) AS r2_full_min, round(max(r2_full), 6) AS r2_full_max,
    round(min(r2_walk), 6) AS r2_walk_min, round(max(r2_walk), 6) AS r2_walk_max FROM cases""",
    ),
)
def leakage_summary(spark, folder):
    common = common_dates(test_forecasts(spark, folder), list(MODELS))
    lagged = at_home(spread(walk(spark, folder), before=1).withColumn("persistence", F.lag("x").over(lane())))
    joined = common.join(lagged.select("series_id", "idx", "persistence"), ["series_id", "idx"])
    return rounded(study_summary(joined, list(MODELS)), 6)


@query(
    "component_scores",
    sql=using(
        "parts",
        select="""SELECT series_id, protocol, comp, model, round(sqrt(avg((y - p) ** 2)), 2) AS rmse,
    round(sqrt(avg((y - last) ** 2)), 2) AS rmse_persistence, round(stddev_pop(p) / nullif(stddev_pop(y), 0), 6) AS std_ratio
    FROM parts WHERE split = 'test' GROUP BY 1, 2, 3, 4""",
    ),
)
def component_scores_q(spark, folder):
    scored = component_scores(parts(spark, folder).where(F.col("split") == "test"))
    return rounded(scored, 2, std_ratio=6)


fragment(
    "features",
    "wins",
    sql="""SELECT series_id, protocol, idx, hf, hf - hf_prev AS d_hf, mid - mid_prev AS d_mid, x - x_last AS dx FROM (
    SELECT series_id, protocol, idx, any_value(x) AS x, sum(w[-1]) AS x_last,
    sum(CASE WHEN comp < 2 THEN w[-1] END) AS hf, sum(CASE WHEN comp < 2 THEN w[-2] END) AS hf_prev,
    sum(CASE WHEN comp BETWEEN 2 AND 4 THEN w[-1] END) AS mid, sum(CASE WHEN comp BETWEEN 2 AND 4 THEN w[-2] END) AS mid_prev
    FROM wins WHERE split = 'test' GROUP BY 1, 2, 3)""",
)
fragment(
    "shared_features",
    "features",
    sql="""SELECT * FROM features
    SEMI JOIN (SELECT series_id, idx FROM features GROUP BY 1, 2 HAVING count(*) = 2) USING (series_id, idx)""",
)


def shared_features(spark, folder):
    """One row per protocol and common test date; built once per session."""
    return remembered(
        spark, folder, "features", lambda s, f: on_common_dates(diagnostic_features(both_windows(s, f)))
    )


@query(
    "diag_features",
    sql=using(
        "features",
        select="""SELECT series_id, protocol, idx, round(hf, 3) AS hf, round(d_hf, 3) AS d_hf, round(d_mid, 2) AS d_mid,
    round(dx, 2) AS dx FROM features""",
    ),
)
def diag_features(spark, folder):
    return rounded(diagnostic_features(both_windows(spark, folder)), 3, d_mid=2, dx=2)


@query(
    "diag_correlation",
    sql=using(
        "shared_features",
        select=f"""SELECT series_id, protocol, n, round(r, 6) AS r,
    round({p_value_sql("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")}, 6) AS p
    FROM (SELECT series_id, protocol, count(*) AS n, corr(hf, dx) AS r FROM shared_features GROUP BY 1, 2)""",
    ),
)
def diag_correlation(spark, folder):
    return rounded(change_correlation(shared_features(spark, folder)), 6)


_SKILL = """SELECT series_id, protocol, count(*) AS n, round(1 - sum(e * e) / sum(dx * dx), 6) AS skill FROM
    (SELECT s.series_id, s.protocol, s.dx, {error} AS e
     FROM folds s JOIN fits f ON f.series_id = s.series_id AND f.protocol = s.protocol AND f.fold = 1 - s.fold)
    GROUP BY 1, 2"""
fragment(
    "folds",
    "shared_features",
    sql="""SELECT *, CAST(row_number() OVER (PARTITION BY series_id, protocol ORDER BY idx)
      > count(*) OVER (PARTITION BY series_id, protocol) // 2 AS INTEGER) AS fold FROM shared_features""",
)
# Normal equations on features demeaned per fold, solved by substitution (Schur complements).
fragment(
    "fits",
    "folds",
    sql="""SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM (
    SELECT *, (c1 - s12 * b2 - s13 * b3) / s11 AS b1 FROM (
    SELECT *, (q2 - q23 * b3) / q22 AS b2 FROM (
    SELECT *, (q3 - q23 * q2 / q22) / (q33 - q23 * q23 / q22) AS b3 FROM (
    SELECT *, s22 - s12 * s12 / s11 AS q22, s23 - s12 * s13 / s11 AS q23, s33 - s13 * s13 / s11 AS q33,
      c2 - s12 * c1 / s11 AS q2, c3 - s13 * c1 / s11 AS q3 FROM (
    SELECT series_id, protocol, fold, avg(dx) AS my, avg(hf) AS m1, avg(d_hf) AS m2, avg(d_mid) AS m3,
      var_pop(hf) AS s11, var_pop(d_hf) AS s22, var_pop(d_mid) AS s33, covar_pop(hf, d_hf) AS s12,
      covar_pop(hf, d_mid) AS s13, covar_pop(d_hf, d_mid) AS s23, covar_pop(dx, hf) AS c1,
      covar_pop(dx, d_hf) AS c2, covar_pop(dx, d_mid) AS c3, regr_slope(dx, hf) AS u1, regr_intercept(dx, hf) AS u0
    FROM folds GROUP BY 1, 2, 3)))))""",
)


@query(
    "diag_skill",
    sql=using("fits", select=_SKILL.format(error="s.dx - f.b0 - f.b1 * s.hf - f.b2 * s.d_hf - f.b3 * s.d_mid")),
)
def diag_skill(spark, folder):
    return rounded(two_fold_skill(shared_features(spark, folder)), 6)


@query("diag_skill_one_feature", sql=using("fits", select=_SKILL.format(error="s.dx - f.u0 - f.u1 * s.hf")))
def diag_skill_one_feature(spark, folder):
    return rounded(two_fold_skill(shared_features(spark, folder), ("hf",)), 6)


@query(
    "boundary_amplitude",
    sql=using(
        "shared_features",
        select="""SELECT series_id, round(stddev_pop(hf) FILTER (WHERE protocol = 'full_series'), 2) AS std_full,
    round(stddev_pop(hf) FILTER (WHERE protocol = 'walk_forward'), 2) AS std_walk,
    round(stddev_pop(hf) FILTER (WHERE protocol = 'walk_forward') / stddev_pop(hf) FILTER (WHERE protocol = 'full_series'), 6) AS ratio
    FROM shared_features GROUP BY 1""",
    ),
)
def boundary_amplitude_q(spark, folder):
    return rounded(boundary_amplitude(shared_features(spark, folder)), 2, ratio=6)


_CELLS = [(p, m) for p in ("full_series", "walk_forward") for m in MODELS]
_ENTRIES = [
    *[("benchmark", "NULL", n, c) for n, c in (("Persistence", "persistence"), ("Drift", "drift"), ("MA-5", "ma5"), ("MA-20", "ma20"), ("EWMA-10", "ewma10"))],
    *[("model", f"'{p}'", m, f"f_{p}_{m}") for p, m in _CELLS],
    *[("input persistence", f"'{p}'", "last value", f"i_{p}") for p in ("full_series", "walk_forward")],
]
fragment(
    "accuracy_rows",
    "fc_test",
    "walk_base",
    sql=f"""SELECT series_id, d.y, persistence, unnest([{", ".join(f"'{e[0]}'" for e in _ENTRIES)}]) AS kind,
    unnest([{", ".join(e[1] for e in _ENTRIES)}]) AS protocol, unnest([{", ".join(f"'{e[2]}'" for e in _ENTRIES)}]) AS name,
    unnest([{", ".join(e[3] for e in _ENTRIES)}]) AS y_pred FROM (SELECT series_id, idx, max(y) AS y,
      {", ".join(f"max(CASE WHEN protocol = '{p}' AND model = '{m}' THEN y_pred END) AS f_{p}_{m}" for p, m in _CELLS)},
      {", ".join(f"max(CASE WHEN protocol = '{p}' THEN input_last END) AS i_{p}" for p in ("full_series", "walk_forward"))}
      FROM fc_test GROUP BY 1, 2 HAVING count(*) = {len(_CELLS)}) d
    JOIN (SELECT * EXCLUDE (protocol, y) FROM walk_base WHERE protocol = 'walk_forward') b USING (series_id, idx)""",
)


@query(
    "accuracy_table",
    sql=using(
        "walk_base",
        "accuracy_rows",
        select=f"""SELECT series_id, kind, protocol, name, n, rmse, mae, mape, r2, CASE WHEN pooled = 0 AND kind <> 'input persistence' THEN round(dm, 4) END AS dm,
    CASE WHEN pooled = 0 AND kind <> 'input persistence' THEN round({p_value_sql("dm", "(n - 1)")}, 6) END AS p FROM (
    SELECT series_id, kind, protocol, name, grouping(series_id) AS pooled, count(*) AS n, {METRICS_SQL}, {dm_sql()} AS dm
    FROM (SELECT *, (y - y_pred) ** 2 - (y - persistence) ** 2 AS d FROM accuracy_rows)
    GROUP BY GROUPING SETS ((series_id, kind, protocol, name), (kind, protocol, name)))""",
    ),
)
def accuracy_table_q(spark, folder):
    """Models, benchmarks and input persistence on the dates that all of them forecast, per series and over all."""
    found = accuracy_table(test_forecasts(spark, folder), benchmark_forecasts(walk(spark, folder)), MODELS)
    return rounded(found, r2=6, dm=4, p=6)


WORST = 7


@query(
    "worst_origins",
    sql=using(
        "fc_test",
        select=f"""SELECT series_id, protocol, model, CAST(rank AS INTEGER) AS rank, idx, round(y, 2) AS y, round(y_pred, 2) AS y_pred, round(error, 2) AS error FROM (
    SELECT *, abs(y - y_pred) AS error, row_number() OVER (PARTITION BY series_id, protocol, model ORDER BY abs(y - y_pred) DESC, idx) AS rank
    FROM fc_test) WHERE rank <= {WORST}""",
    ),
)
def worst_origins(spark, folder):
    """The test rows with the largest errors of every series, protocol and model."""
    return rounded(worst_rows(test_forecasts(spark, folder), ["series_id", "protocol", "model"], WORST), 2)
