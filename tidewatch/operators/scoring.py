"""Scores of forecasts and tests between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.losses import dm_aggregates, dm_statistic, error_metrics, loss_difference
from tidewatch.functions.tdist import two_sided_p
from tidewatch.operators.blocks import BLOCK_ROWS, at_home, home_block, lane, spread


def score(forecasts: DataFrame, by: Sequence[str], y: str = "y", pred: str = "y_pred") -> DataFrame:
    """RMSE, MAE, MAPE and R2 per group."""
    return forecasts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *error_metrics(F.col(y), F.col(pred)))


def with_test(moment_rows: DataFrame, h: int = 1, dm: str = "dm", p: str = "p") -> DataFrame:
    """Turn ``dm_aggregates`` columns into the statistic and its p-value."""
    named = moment_rows.withColumn(dm, dm_statistic(h))
    named = named.withColumn(p, two_sided_p(F.col(dm), F.col("_t") - 1))
    return named.drop(*[c for c in named.columns if c.startswith("_")])


def dm_by_group(pairs: DataFrame, by: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    """One-step modified Diebold-Mariano test of forecast ``a`` against ``b`` per group."""
    d = pairs.withColumn("d", loss_difference(F.col(y), F.col(a), F.col(b)))
    return with_test(d.groupBy(*by).agg(*dm_aggregates("d")))


def dm_by_group_h(
    pairs: DataFrame, by: Sequence[str], y: str, a: str, b: str, h: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The h-step test; ``by`` must identify a series so that ``idx`` is its order."""
    d = pairs.select(*by, "idx", loss_difference(F.col(y), F.col(a), F.col(b)).alias("d"))
    rows = spread(d, before=h - 1, block_rows=block_rows)
    rows = rows.withColumns({f"d_{k}": F.lag("d", k).over(lane(by)) for k in range(1, h)})
    return with_test(at_home(rows, block_rows).groupBy(*by).agg(*dm_aggregates("d", h)), h)


def verdicts(dm: str = "dm", p: str = "p") -> list[Column]:
    """Both significance rules and the direction; NULL statistics are never significant."""
    return [
        F.coalesce(F.abs(F.col(dm)) > 1.96, F.lit(False)).alias("sig_196"),
        F.coalesce(F.col(p) < 0.05, F.lit(False)).alias("sig_p05"),
        (F.col(dm) > 0).alias("model_worse"),
    ]


def baseline_scoreboard(long: DataFrame) -> DataFrame:
    """Metrics of every benchmark and its test against persistence, in one aggregate."""
    d = long.withColumn("d", loss_difference(F.col("y"), F.col("y_pred"), F.col("persistence")))
    scored = d.groupBy("series_id", "baseline").agg(
        F.count(F.lit(1)).alias("n"), *error_metrics(F.col("y"), F.col("y_pred")), *dm_aggregates("d")
    )
    return with_test(scored, dm="dm_vs_persistence", p="p_vs_persistence")


def relative_errors(long: DataFrame) -> DataFrame:
    """RMSE of every benchmark over persistence, with the range across series.

    Both errors come from one aggregate; the range joins one row per benchmark.
    """
    y = F.col("y")
    ratios = (
        long.groupBy("series_id", "baseline")
        .agg(
            F.sqrt(F.avg((y - F.col("y_pred")) * (y - F.col("y_pred")))).alias("_r"),
            F.sqrt(F.avg((y - F.col("persistence")) * (y - F.col("persistence")))).alias("_p"),
        )
        .withColumn("ratio", F.col("_r") / F.nullif(F.col("_p"), F.lit(0.0)))
    )
    ranges = ratios.groupBy("baseline").agg(F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"))
    return ratios.join(ranges, "baseline").select(
        "series_id", "baseline", ((F.col("ratio") - 1) * 100).alias("pct_worse"), "ratio", "ratio_min", "ratio_max"
    )


def comparison_table(forecasts: DataFrame, baselines: DataFrame) -> DataFrame:
    """Every model forecast against every benchmark: statistic, p-value and verdicts.

    ``forecasts`` are test rows ``(series_id, protocol, model, idx, y, y_pred)``;
    ``baselines`` the wide benchmark forecasts per ``(series_id, protocol, idx)``.
    """
    pairs = forecasts.join(baselines.drop("y"), ["series_id", "protocol", "idx"])
    d = pairs.select(
        "series_id",
        "protocol",
        "model",
        "y",
        "y_pred",
        F.expr(
            "stack(5, 'Persistence', persistence, 'Drift', drift, 'MA-5', ma5, 'MA-20', ma20,"
            " 'EWMA-10', ewma10) AS (baseline, b_pred)"
        ),
    )
    tested = dm_by_group(d, ["series_id", "protocol", "model", "baseline"], "y", "y_pred", "b_pred")
    return tested.select("*", *verdicts())


def side_by_side(forecasts: DataFrame, columns: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per ``keys``: ``y`` and, per named condition, that forecast (NULL where absent)."""
    return forecasts.groupBy(*keys).agg(
        F.max("y").alias("y"), *[F.max(F.when(where, F.col("y_pred"))).alias(name) for name, where in columns.items()]
    )


def protocol_pairs(forecasts: DataFrame) -> DataFrame:
    """Test forecasts of both protocols on one row per (series, model, idx)."""
    return side_by_side(
        forecasts,
        {"p_full": F.col("protocol") == "full_series", "p_walk": F.col("protocol") == "walk_forward"},
        ["series_id", "model", "idx"],
    )


def leakage_inflation(forecasts: DataFrame) -> DataFrame:
    """Error under the causal protocol over error under the other, on dates both tested."""
    pairs = protocol_pairs(forecasts)
    both = F.col("p_full").isNotNull() & F.col("p_walk").isNotNull()

    def rmse(pred: str) -> Column:
        e = F.when(both, F.col("y") - F.col(pred))
        return F.sqrt(F.avg(e * e))

    def mape(pred: str) -> Column:
        share = F.abs(F.col("y") - F.col(pred)) / F.greatest(F.abs(F.col("y")), F.lit(1e-8))
        return F.avg(F.when(both, share)) * 100

    return (
        pairs.groupBy("series_id", "model")
        .agg(
            F.count_if(both).alias("common_dates"),
            F.count_if(F.col("p_walk").isNull()).alias("full_only"),
            F.count_if(F.col("p_full").isNull()).alias("walk_only"),
            rmse("p_full").alias("rmse_full"),
            rmse("p_walk").alias("rmse_walk"),
            mape("p_full").alias("mape_full"),
            mape("p_walk").alias("mape_walk"),
        )
        .withColumn("inflation_ratio", F.col("rmse_walk") / F.nullif(F.col("rmse_full"), F.lit(0.0)))
    )


def all_forecasts_wide(forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per (series, idx) with ``<protocol>_<model>`` columns."""
    return side_by_side(
        forecasts,
        {
            f"{short}_{m}": (F.col("protocol") == p) & (F.col("model") == m)
            for short, p in (("full", "full_series"), ("walk", "walk_forward"))
            for m in models
        },
        ["series_id", "idx"],
    )


def common_dates(forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows every protocol and model forecast; the columns of ``all_forecasts_wide``."""
    wide = all_forecasts_wide(forecasts, models)
    for m in models:
        wide = wide.where(F.col(f"full_{m}").isNotNull() & F.col(f"walk_{m}").isNotNull())
    return wide


def dm_pairwise(common: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Test named columns against each other; one pass for all pairs."""
    rows = F.array(
        *[
            F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.col(a).alias("a_pred"), F.col(b).alias("b_pred"))
            for a, b in pairs
        ]
    )
    long = common.select("series_id", "y", F.inline(rows))
    return dm_by_group(long, ["series_id", "pair"], "y", "a_pred", "b_pred")


def study_summary(common: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row over all (series, model) cases: leakage ratio range, counts of significant tests, error ranges.

    ``common`` also carries ``persistence``.
    """
    cases = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(f"full_{m}").alias("a"), F.col(f"walk_{m}").alias("b"))
            for m in models
        ]
    )
    long = common.select("series_id", "y", "persistence", F.inline(cases))
    y, a, b, p = F.col("y"), F.col("a"), F.col("b"), F.col("persistence")
    losses = {"wa": loss_difference(y, b, a), "ap": loss_difference(y, a, p), "bp": loss_difference(y, b, p)}
    scored = long.withColumns(losses).groupBy("series_id", "model").agg(
        *[m.alias(f"{n}_full") for m, n in zip(error_metrics(y, a), ("rmse", "mae", "mape", "r2"))],
        *[m.alias(f"{n}_walk") for m, n in zip(error_metrics(y, b), ("rmse", "mae", "mape", "r2"))],
        *[
            F.struct(*[c for c in dm_aggregates(d)]).alias(f"_dm_{d}") for d in losses
        ],
    )
    for d in losses:
        moments = scored.select("*", *[F.col(f"_dm_{d}")[c].alias(c) for c in ("_t", "_mean", "_g0")])
        scored = (
            moments.withColumn(f"dm_{d}", dm_statistic(1))
            .withColumn(f"p_{d}", two_sided_p(F.col(f"dm_{d}"), F.col("_t") - 1))
            .drop("_t", "_mean", "_g0", f"_dm_{d}")
        )
    rho = F.col("rmse_walk") / F.nullif(F.col("rmse_full"), F.lit(0.0))

    def significant(d: str, sign: int) -> Column:
        return F.count_if((F.col(f"dm_{d}") * sign > 0) & (F.col(f"p_{d}") < 0.05))

    return scored.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.min(rho).alias("rho_min"),
        F.max(rho).alias("rho_max"),
        F.exp(F.avg(F.log(rho))).alias("rho_geomean"),
        significant("wa", 1).alias("walk_significantly_worse"),
        significant("ap", -1).alias("full_beats_persistence"),
        significant("bp", -1).alias("walk_beats_persistence"),
        significant("ap", 1).alias("full_worse_than_persistence"),
        significant("bp", 1).alias("walk_worse_than_persistence"),
        *[
            f(f"{m}_{s}").alias(f"{m}_{s}_{n}")
            for m in ("mape", "r2")
            for s in ("full", "walk")
            for f, n in ((F.min, "min"), (F.max, "max"))
        ],
    )


def component_scores(parts: DataFrame) -> DataFrame:
    """Component forecasts in component units, against the component's own last value.

    ``std_ratio`` near zero means a forecast that collapsed to a constant.
    """
    y, p, last = F.col("y"), F.col("p"), F.col("last")
    return parts.groupBy("series_id", "protocol", "comp", "model").agg(
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.sqrt(F.avg((y - last) * (y - last))).alias("rmse_persistence"),
        (F.stddev_pop(p) / F.nullif(F.stddev_pop(y), F.lit(0.0))).alias("std_ratio"),
    )


def accuracy_table(forecasts: DataFrame, benchmarks: DataFrame, models: Sequence[str], inputs: str = "input_last") -> DataFrame:
    """Accuracy on the dates that every protocol and model forecast: ``(series_id, kind, protocol, name, n, ..., dm, p)``.

    Beside the models (``kind`` model) stand the benchmarks, and ``input persistence``: the added-up last values of a protocol's
    input windows, which is what copying the input would score. Each has a row per series, models and benchmarks with their test against
    persistence, and one over all series (``series_id`` is NULL, no test). One pass over the forecasts collects a date's
    values, one aggregate with grouping sets scores them.

    ``forecasts``: test rows (series_id, protocol, model, idx, y, y_pred, and ``inputs``); ``benchmarks``: wide rows of ``benchmark_forecasts``.
    """
    cells = [(p, m) for p in ("full_series", "walk_forward") for m in models]
    named = lambda k: [(F.col("protocol") == p) & (F.col("model") == m) for p, m in cells][k]
    dates = forecasts.groupBy("series_id", "idx").agg(
        F.max("y").alias("y"),
        *[F.max(F.when(named(k), F.col("y_pred"))).alias(f"_f{k}") for k in range(len(cells))],
        *[F.max(F.when(F.col("protocol") == p, F.col(inputs))).alias(f"_i{j}") for j, p in enumerate(("full_series", "walk_forward"))],
    )
    for k in range(len(cells)):
        dates = dates.where(F.col(f"_f{k}").isNotNull())
    rows = dates.join(benchmarks.drop("y"), ["series_id", "idx"])
    entry = lambda kind, protocol, name, value: F.struct(
        F.lit(kind).alias("kind"), F.lit(protocol).cast("string").alias("protocol"), F.lit(name).alias("name"), F.col(value).alias("y_pred")
    )
    entries = [entry("benchmark", None, n, c) for n, c in (("Persistence", "persistence"), ("Drift", "drift"), ("MA-5", "ma5"), ("MA-20", "ma20"), ("EWMA-10", "ewma10"))]
    entries += [entry("model", p, m, f"_f{k}") for k, (p, m) in enumerate(cells)]
    entries += [entry("input persistence", p, "last value", f"_i{j}") for j, p in enumerate(("full_series", "walk_forward"))]
    long = rows.select("series_id", "y", "persistence", F.inline(F.array(*entries)))
    long = long.withColumn("d", loss_difference(F.col("y"), F.col("y_pred"), F.col("persistence")))
    sets = [["series_id", "kind", "protocol", "name"], ["kind", "protocol", "name"]]
    columns = [F.col(c) for c in sets[0]]
    scored = long.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping("series_id").alias("pooled"), F.count(F.lit(1)).alias("n"), *error_metrics(F.col("y"), F.col("y_pred")), *dm_aggregates("d")
    )
    tested = with_test(scored)
    alone = (F.col("pooled") == 0) & (F.col("kind") != "input persistence")  # those are persistence itself but for rounding
    return tested.withColumns({c: F.when(alone, F.col(c)) for c in ("dm", "p")}).drop("pooled")


def worst_rows(forecasts: DataFrame, by: Sequence[str], k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` rows with the largest absolute errors of every group, ties by ``idx``: ``(by, rank, idx, y, y_pred, error)``.

    At most k rows of each block of a group are handed on, then at most k of the group: no sort of all rows.
    """
    rows = forecasts.select(*by, "idx", "y", "y_pred", F.abs(F.col("y") - F.col("y_pred")).alias("error")).where(F.col("error").isNotNull())
    order = [F.desc("error"), F.asc("idx")]
    first = Window.partitionBy(*by, "block").orderBy(*order)
    few = rows.withColumn("block", home_block(block_rows)).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank", "block")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select(*by, "rank", "idx", "y", "y_pred", "error")
