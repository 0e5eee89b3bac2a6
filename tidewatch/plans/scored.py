"""Benchmark forecasts, their scores and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.tdist import two_sided_p
from tidewatch.operators.baselines import BASELINES, benchmark_forecasts, long_forecasts
from tidewatch.operators.scoring import baseline_scoreboard, dm_by_group, dm_by_group_h, score
from tidewatch.plans.inputs import item_series
from tidewatch.plans.registry import fragment, query, using


def p_value_sql(t: str, df: str) -> str:
    """Two-sided Student-t p-value for integer df, by Horner's scheme."""
    theta = f"atan(abs({t}) / sqrt({df}))"

    def horner(first: int) -> str:
        return (
            f"list_reduce(list_transform(list_reverse(range({first}, CAST({df} - 1 AS BIGINT), 2)), lambda k: CAST(k AS DOUBLE)),"
            f" lambda acc, k: 1 + cos({theta}) * cos({theta}) * (k - 1) / k * acc, CAST(1 AS DOUBLE))"
        )

    return (
        f"CASE WHEN {t} IS NULL THEN NULL WHEN {df} % 2 = 0 THEN greatest(0, 1 - sin({theta}) * {horner(2)})"
        f" ELSE greatest(0, 1 - 2 / pi() * ({theta} + sin({theta}) * cos({theta}) * {horner(3)})) END"
    )


METRICS_SQL = """round(sqrt(avg((y - y_pred) ** 2)), 4) AS rmse, round(avg(abs(y - y_pred)), 4) AS mae,
    round(avg(abs(y - y_pred) / greatest(abs(y), 1e-8)) * 100, 4) AS mape,
    round(1 - sum((y - y_pred) ** 2) / nullif(count(*) * var_pop(y), 0), 6) AS r2"""

fragment(
    "lagged",
    "series",
    sql="""SELECT *, lag(x) OVER o AS persistence,
    avg(x) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ma5,
    avg(x) OVER (o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ma20,
    avg(x) OVER (o ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean10,
    first_value(x) OVER o AS x0,
    max(CASE WHEN idx = train_end - 1 THEN x END) OVER (PARTITION BY series_id) AS xs
    FROM series WINDOW o AS (PARTITION BY series_id ORDER BY idx)""",
)
fragment(
    "base",
    "lagged",
    sql="""SELECT series_id, idx, x AS y, persistence,
    persistence + (xs - x0) / greatest(train_end - 1, 1) AS drift, ma5, ma20,
    list_reduce(list(persistence) OVER t, lambda acc, v: (2.0 / 11) * v + (1 - 2.0 / 11) * acc,
                first_value(mean10) OVER t) AS ewma10
    FROM lagged WHERE idx >= train_end WINDOW t AS (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
)
fragment(
    "base_long",
    "base",
    sql="""SELECT series_id, idx, y, persistence, 'Persistence' AS baseline, persistence AS y_pred FROM base
    UNION ALL SELECT series_id, idx, y, persistence, 'Drift', drift FROM base
    UNION ALL SELECT series_id, idx, y, persistence, 'MA-5', ma5 FROM base
    UNION ALL SELECT series_id, idx, y, persistence, 'MA-20', ma20 FROM base
    UNION ALL SELECT series_id, idx, y, persistence, 'EWMA-10', ewma10 FROM base""",
)
fragment(
    "base_scores",
    "base_long",
    sql=f"""SELECT series_id, baseline, count(*) AS n, {METRICS_SQL},
    CASE WHEN var_pop(d) > 0 THEN avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1.0) / count(*)) END AS dm
    FROM (SELECT *, (y - y_pred) ** 2 - (y - persistence) ** 2 AS d FROM base_long) GROUP BY 1, 2""",
)


def forecasts(spark, folder):
    return benchmark_forecasts(item_series(spark, folder))


def rounded(df, digits=4, **more):
    """Round double columns for comparison; ``more`` overrides digits per column."""
    return df.select(
        *[F.round(c, more.get(c, digits)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def _one_baseline(name: str, column: str):
    @query(
        name,
        sql=using("base", select=f"SELECT series_id, idx, y, round({column}, 4) AS y_pred FROM base"),
    )
    def build(spark, folder, column=column):
        return forecasts(spark, folder).select("series_id", "idx", "y", F.round(column, 4).alias("y_pred"))

    return build


_one_baseline("fc_persistence", "persistence")
_one_baseline("fc_drift", "drift")
_one_baseline("fc_ewma", "ewma10")


@query(
    "fc_moving_average",
    sql=using("base", select="SELECT series_id, idx, y, round(ma5, 4) AS ma5, round(ma20, 4) AS ma20 FROM base"),
)
def fc_moving_average(spark, folder):
    return rounded(forecasts(spark, folder).select("series_id", "idx", "y", "ma5", "ma20"))


@query(
    "fc_all_baselines",
    sql=using(
        "base_long", select="SELECT series_id, idx, y, baseline, round(y_pred, 4) AS y_pred FROM base_long"
    ),
)
def fc_all_baselines(spark, folder):
    return rounded(long_forecasts(forecasts(spark, folder)).drop("persistence"))


@query("metrics", sql=using("base_scores", select="SELECT series_id, baseline, n, rmse, mae, mape, r2 FROM base_scores"))
def metrics(spark, folder):
    return rounded(score(long_forecasts(forecasts(spark, folder)), ["series_id", "baseline"]), r2=6)


@query(
    "dm_test",
    sql=using("base_scores", select="SELECT series_id, baseline, round(dm, 6) AS dm FROM base_scores"),
)
def dm_test(spark, folder):
    tested = dm_by_group(
        long_forecasts(forecasts(spark, folder)), ["series_id", "baseline"], "y", "y_pred", "persistence"
    )
    return rounded(tested.select("series_id", "baseline", "dm"), dm=6)


@query(
    "dm_test_h3",
    sql=using(
        "base",
        select=f"""SELECT series_id, round(dm, 6) AS dm, round({p_value_sql("dm", "(t - 1)")}, 6) AS p FROM (
    SELECT series_id, t, CASE WHEN v > 0 THEN d_bar / sqrt(v) * sqrt((t + 1 - 6 + 6.0 / t) / t) END AS dm FROM (
    SELECT series_id, count(*) AS t, any_value(d_bar) AS d_bar,
    (avg((d - d_bar) ** 2) + 2 * (avg((d - d_bar) * (d1 - d_bar)) + avg((d - d_bar) * (d2 - d_bar)))) / count(*) AS v
    FROM (SELECT *, avg(d) OVER (PARTITION BY series_id) AS d_bar,
          lag(d, 1) OVER (PARTITION BY series_id ORDER BY idx) AS d1,
          lag(d, 2) OVER (PARTITION BY series_id ORDER BY idx) AS d2
          FROM (SELECT series_id, idx, (y - ma5) ** 2 - (y - persistence) ** 2 AS d FROM base))
    GROUP BY 1))""",
    ),
)
def dm_test_h3(spark, folder):
    tested = dm_by_group_h(forecasts(spark, folder), ["series_id"], "y", "ma5", "persistence", h=3)
    return rounded(tested, 6)


@query(
    "t_pvalue",
    sql=using(
        "base_scores",
        select=f"""SELECT series_id, baseline, round({p_value_sql("dm", "(n - 1)")}, 9) AS p,
    round({p_value_sql("1.7", "(n - 1)")}, 9) AS p_fixed FROM base_scores""",
    ),
)
def t_pvalue(spark, folder):
    scored = baseline_scoreboard(long_forecasts(forecasts(spark, folder)))
    return scored.select(
        "series_id",
        "baseline",
        F.round("p_vs_persistence", 9).alias("p"),
        F.round(two_sided_p(F.lit(1.7), F.col("n") - 1), 9).alias("p_fixed"),
    )


@query(
    "baselines_scoreboard",
    sql=using(
        "base_scores",
        select=f"""SELECT series_id, baseline, n, rmse, mae, mape, r2, round(dm, 6) AS dm_vs_persistence,
    round({p_value_sql("dm", "(n - 1)")}, 6) AS p_vs_persistence FROM base_scores""",
    ),
)
def baselines_scoreboard(spark, folder):
    scored = baseline_scoreboard(long_forecasts(forecasts(spark, folder)))
    return rounded(scored, r2=6, dm_vs_persistence=6, p_vs_persistence=6)


@query(
    "baseline_pivot",
    sql=using(
        "base_scores",
        select="""SELECT baseline, max(CASE WHEN series_id = 'A_High' THEN rmse END) AS A_High,
    max(CASE WHEN series_id = 'A_Low' THEN rmse END) AS A_Low,
    max(CASE WHEN series_id = 'N_High' THEN rmse END) AS N_High,
    max(CASE WHEN series_id = 'N_Low' THEN rmse END) AS N_Low,
    max(CASE WHEN series_id = 'R_High' THEN rmse END) AS R_High,
    max(CASE WHEN series_id = 'R_Low' THEN rmse END) AS R_Low FROM base_scores GROUP BY 1""",
    ),
)
def baseline_pivot(spark, folder):
    scored = score(long_forecasts(forecasts(spark, folder)), ["series_id", "baseline"])
    # The series there are; more than Spark allows to become columns is an error, never a silent loss.
    return scored.groupBy("baseline").pivot("series_id").agg(F.round(F.max("rmse"), 4))


@query(
    "relative_to_persistence",
    sql=using(
        "base_long",
        select="""SELECT s.series_id, s.baseline, round((s.r / p.r - 1) * 100, 4) + CAST(0 AS DOUBLE) AS pct_worse, round(s.r / p.r, 6) AS ratio,
    round(min(s.r / p.r) OVER (PARTITION BY s.baseline), 6) AS ratio_min,
    round(max(s.r / p.r) OVER (PARTITION BY s.baseline), 6) AS ratio_max
    FROM (SELECT series_id, baseline, sqrt(avg((y - y_pred) ** 2)) AS r FROM base_long GROUP BY 1, 2) s
    JOIN (SELECT series_id, sqrt(avg((y - persistence) ** 2)) AS r FROM base GROUP BY 1) p USING (series_id)""",
    ),
)
def relative_to_persistence(spark, folder):
    from tidewatch.operators.scoring import relative_errors

    return rounded(relative_errors(long_forecasts(forecasts(spark, folder))), 6, pct_worse=4)
