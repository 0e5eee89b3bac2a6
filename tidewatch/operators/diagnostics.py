"""How much of the next change the inputs already contain, without any model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.linear import coefficients, moments
from tidewatch.functions.tdist import two_sided_p
from tidewatch.operators.blocks import BLOCK_ROWS, join_totals

FEATURES = ("hf", "d_hf", "d_mid")


def diagnostic_features(windows: DataFrame, fast: int = 2) -> DataFrame:
    """Per test row: the fast group at the window end, its change, and the change of the middle group.

    The first ``fast`` components form the fast group, the rest without the residual
    the middle group.  ``dx`` is the change of the series the row is to forecast.
    """
    test = windows.where(F.col("split") == "test")
    last, previous = F.element_at("w", -1), F.element_at("w", -2)
    residual = F.max("comp")
    rows = test.groupBy("series_id", "protocol", "idx").agg(
        F.sum(F.when(F.col("comp") < fast, last)).alias("hf"),
        F.sum(F.when(F.col("comp") < fast, previous)).alias("_hf_prev"),
        F.sum(F.when(F.col("comp") >= fast, last)).alias("_rest"),
        F.sum(F.when(F.col("comp") >= fast, previous)).alias("_rest_prev"),
        F.max_by(last, "comp").alias("_residual"),
        F.max_by(previous, "comp").alias("_residual_prev"),
        F.sum(last).alias("x_last"),
        F.max("x").alias("x"),
        residual.alias("_c"),
    )
    return rows.select(
        "series_id",
        "protocol",
        "idx",
        "hf",
        (F.col("hf") - F.col("_hf_prev")).alias("d_hf"),
        ((F.col("_rest") - F.col("_residual")) - (F.col("_rest_prev") - F.col("_residual_prev"))).alias("d_mid"),
        (F.col("x") - F.col("x_last")).alias("dx"),
    )


def on_common_dates(features: DataFrame) -> DataFrame:
    """Keep rows both protocols test; a date has at most one row per protocol."""
    on_date = Window.partitionBy("series_id", "idx")
    return features.withColumn("_k", F.count(F.lit(1)).over(on_date)).where(F.col("_k") == 2).drop("_k")


def change_correlation(features: DataFrame, feature: str = "hf") -> DataFrame:
    """Pearson r between the fast group and the next change, with its two-sided p-value."""
    r = features.groupBy("series_id", "protocol").agg(
        F.count(F.lit(1)).alias("n"), F.corr(feature, "dx").alias("r")
    )
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return r.withColumn("p", two_sided_p(t, F.col("n") - 2))


def two_fold_skill(
    features: DataFrame, names: tuple[str, ...] = FEATURES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """1 - SSE(regression)/SSE(no change), fitted on one half of the dates and scored on the other.

    Halves are by position; dates are contiguous, so position is the distance from
    the first one.  Both the fit and its error on the other half follow from the
    second moments of the halves, so the rows are aggregated once.
    """
    keys = ("series_id", "protocol")
    bounds = features.groupBy(*keys).agg(
        F.max("idx").alias("_last_idx"), F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    rows = join_totals(features, bounds, "_last_idx", keys, block_rows)
    rows = rows.withColumn("fold", (F.col("idx") - F.col("_first") >= F.floor(F.col("_n") / 2)).cast("int"))
    k = len(names)
    halves = rows.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("_n"), *moments("dx", list(names)))
    stats = [c for c in halves.columns if c not in (*keys, "fold")]
    fit = F.struct(*[c.alias(b) for b, c in coefficients(k).items()])
    both = (
        halves.select(*keys, "fold", fit.alias("_fit"), F.struct(*stats).alias("_half"))
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("fold") == f, F.col(c))).alias(f"{c}{f}")
                for f in (0, 1)
                for c in ("_fit", "_half")
            ]
        )
    )
    sse_fit = _sse_elsewhere("_fit0", "_half1", k) + _sse_elsewhere("_fit1", "_half0", k)
    sse_none = F.lit(0.0)
    for f in (0, 1):
        half = F.col(f"_half{f}")
        sse_none = sse_none + half["_n"] * (half["_v00"] + half["_m0"] * half["_m0"])
    return both.select(
        *keys,
        (F.col("_half0")["_n"] + F.col("_half1")["_n"]).alias("n"),
        (1 - sse_fit / F.nullif(sse_none, F.lit(0.0))).alias("skill"),
    )


def _sse_elsewhere(fit: str, half: str, k: int) -> Column:
    """Squared error of one half's coefficients on the other half, from that half's moments."""
    m = F.col(half)
    b = [F.col(fit)[f"b{i}"] for i in range(k + 1)]
    bias = m["_m0"] - b[0]
    spread = m["_v00"]
    for i in range(1, k + 1):
        bias = bias - b[i] * m[f"_m{i}"]
        spread = spread - 2 * b[i] * m[f"_v0{i}"]
        for j in range(1, k + 1):
            spread = spread + b[i] * b[j] * m[f"_v{min(i, j)}{max(i, j)}"]
    return m["_n"] * (spread + bias * bias)


def boundary_amplitude(features: DataFrame) -> DataFrame:
    """Spread of the fast group at the window end under each protocol, and their ratio."""
    full = F.stddev_pop(F.when(F.col("protocol") == "full_series", F.col("hf")))
    walk = F.stddev_pop(F.when(F.col("protocol") == "walk_forward", F.col("hf")))
    return features.groupBy("series_id").agg(
        full.alias("std_full"), walk.alias("std_walk"), (walk / F.nullif(full, F.lit(0.0))).alias("ratio")
    )
