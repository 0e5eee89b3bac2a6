"""Sifting and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.blocks import with_totals
from tidewatch.operators.centred import HALF_WIDTHS, decompose_centred
from tidewatch.operators.ensemble import (
    antithetic_realisations,
    common_depth,
    ensemble_decompose,
    ensemble_mean,
    fit_components,
    uncorrected_mean_error,
)
from tidewatch.operators.sift import levels_worth_sifting, linear_envelopes, mark_extrema, sift_converged, sift_decompose, sift_pass
from tidewatch.plans.inputs import COMPONENTS, walk
from tidewatch.plans.registry import fragment, query, using
from tidewatch.plans.scored import rounded

LEVELS, PASSES = 3, 3


def _envelope_sql(side: str) -> str:
    left, right = f"coalesce({side}_b, {side}_a)", f"coalesce({side}_a, {side}_b)"
    return f"""CASE WHEN {side}_n < 4 THEN m WHEN {right}.i > {left}.i
    THEN {left}.v + ({right}.v - {left}.v) * (idx - {left}.i) / ({right}.i - {left}.i) ELSE {left}.v END"""


def _declare_pass(name: str, source: str, value: str) -> None:
    """Fragments ``<name>_ext`` (extrema), ``<name>_env`` (envelopes) of ``source``."""
    point = f"struct_pack(i := idx, v := {value})"
    fragment(
        f"{name}_ext",
        source,
        sql=f"""SELECT *, CASE WHEN {value} > back AND {value} > ahead THEN {point} END AS top,
        CASE WHEN {value} < back AND {value} < ahead THEN {point} END AS low FROM (
        SELECT *, lag({value}) OVER o AS back, lead({value}) OVER o AS ahead FROM {source}
        WINDOW o AS (PARTITION BY series_id ORDER BY idx))""",
    )
    fragment(
        f"{name}_env",
        f"{name}_ext",
        sql=f"""SELECT * EXCLUDE (top, low, back, ahead, top_b, top_a, low_b, low_a, top_n, low_n, m),
        {_envelope_sql("top")} AS upper, {_envelope_sql("low")} AS lower FROM (SELECT *,
        last_value(top IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top_b,
        first_value(top IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top_a,
        last_value(low IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low_b,
        first_value(low IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low_a,
        count(top) OVER (PARTITION BY series_id) AS top_n, count(low) OVER (PARTITION BY series_id) AS low_n,
        avg({value}) OVER (PARTITION BY series_id) AS m FROM {name}_ext WINDOW o AS (PARTITION BY series_id ORDER BY idx))""",
    )


_declare_pass("first", "walk", "x")
_source = "walk"
for _level in range(LEVELS):
    _rest = "x" if _level == 0 else "rest"
    fragment(f"h{_level}_0", _source, sql=f"SELECT *, {_rest} AS h FROM {_source}" if _level else f"SELECT series_id, idx, x, x AS rest, x AS h FROM {_source}")
    for _pass in range(PASSES):
        _declare_pass(f"p{_level}_{_pass}", f"h{_level}_{_pass}", "h")
        fragment(
            f"h{_level}_{_pass + 1}",
            f"p{_level}_{_pass}_env",
            sql=f"SELECT * REPLACE (h - (upper + lower) / 2 AS h) FROM (SELECT * FROM p{_level}_{_pass}_env)".replace(
                "SELECT * REPLACE", "SELECT * EXCLUDE (upper, lower) REPLACE"
            ),
        )
    _source = f"done{_level}"
    fragment(
        _source,
        f"h{_level}_{PASSES}",
        sql=f"SELECT * EXCLUDE (h) REPLACE (rest - h AS rest), h AS c{_level} FROM h{_level}_{PASSES}",
    )


@query(
    "local_extrema",
    sql=using(
        "first_ext",
        select="""SELECT series_id, idx, x, CASE WHEN top IS NOT NULL THEN 'max' ELSE 'min' END AS kind
    FROM first_ext WHERE top IS NOT NULL OR low IS NOT NULL""",
    ),
)
def local_extrema(spark, folder):
    marked = mark_extrema(walk(spark, folder)).where(F.col("is_max") | F.col("is_min"))
    return marked.select("series_id", "idx", "x", F.when(F.col("is_max"), "max").otherwise("min").alias("kind"))


@query(
    "linear_envelope",
    sql=using(
        "first_env", select="SELECT series_id, idx, round(upper, 4) AS upper, round(lower, 4) AS lower FROM first_env"
    ),
)
def linear_envelope(spark, folder):
    return rounded(linear_envelopes(walk(spark, folder)).select("series_id", "idx", "upper", "lower"))


@query(
    "sift_pass",
    sql=using("first_env", select="SELECT series_id, idx, round(x - (upper + lower) / 2, 4) AS h FROM first_env"),
)
def sift_pass_q(spark, folder):
    return rounded(sift_pass(walk(spark, folder)).select("series_id", "idx", F.col("x").alias("h")))


@query(
    "sift_decompose",
    sql=using(
        f"done{LEVELS - 1}",
        select=f"""SELECT series_id, idx, {", ".join(f"round(c{j}, 3) AS c{j}" for j in range(LEVELS))},
    round(rest, 3) AS c{LEVELS} FROM done{LEVELS - 1}""",
    ),
)
def sift_decompose_q(spark, folder):
    done = sift_decompose(walk(spark, folder), LEVELS, PASSES)
    return rounded(done.select("series_id", "idx", *[f"c{j}" for j in range(LEVELS + 1)]), 3)


PAIRS = 4


@query(
    "antithetic_mean_is_signal",
    sql=using(
        "walk",
        select=f"""SELECT series_id, count(*) AS n, CAST({2 * PAIRS} AS BIGINT) AS realisations,
    CAST(0 AS DOUBLE) AS max_abs_diff, true AS has_noise, true AS spread_as_asked FROM walk GROUP BY 1""",
    ),
)
def antithetic_mean_is_signal(spark, folder):
    copies = antithetic_realisations(walk(spark, folder), PAIRS)
    means = copies.groupBy("series_id", "idx").agg(
        F.max("x").alias("x"), F.avg("v").alias("mean"), F.count("v").alias("k"), F.avg(F.abs(F.col("v") - F.col("x"))).alias("_w"),
        F.var_pop("v").alias("_var"),
    )
    asked = F.sqrt(F.avg("_var")) / F.stddev_pop("x") / 0.2
    return means.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("k").alias("realisations"),
        (F.round(F.max(F.abs(F.col("mean") - F.col("x"))), 4) + 0.0).alias("max_abs_diff"),
        (F.min("_w") > 0).alias("has_noise"),
        asked.between(0.95, 1.05).alias("spread_as_asked"),
    )


REALISATIONS, FITTED = 4, 4


def varying_depth(spark, folder):
    """Realisations of 2 to 5 detail levels each, as a decomposition with unstable depth yields them."""
    wide = decompose_centred(walk(spark, folder))
    levels = [F.col("x")]
    for j in range(COMPONENTS - 1):
        levels.append(levels[-1] - F.col(f"c{j}"))
    parts = []
    for r in range(REALISATIONS):
        depth = 2 + r
        for j in range(depth):
            parts.append((r, j, False, F.col(f"c{j}")))
        parts.append((r, depth, True, levels[depth]))
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("realisation"), F.lit(j).alias("comp"), F.lit(res).alias("is_residual"), c.alias("c"))
            for r, j, res, c in parts
        ]
    )
    return wide.select("series_id", "idx", F.inline(rows))


_parts = []
for _r in range(REALISATIONS):
    _names = ["x", *[f"l{h}" for h in HALF_WIDTHS]]
    for _j in range(2 + _r):
        _parts.append((_r, _j, "false", f"{_names[_j]} - {_names[_j + 1]}"))
    _parts.append((_r, 2 + _r, "true", _names[2 + _r]))
fragment(
    "varying",
    "levels",
    sql=f"""SELECT series_id, idx, x, unnest([{", ".join(str(p[0]) for p in _parts)}]) AS realisation,
    unnest([{", ".join(str(p[1]) for p in _parts)}]) AS comp, unnest([{", ".join(p[2] for p in _parts)}]) AS is_residual,
    unnest([{", ".join(p[3] for p in _parts)}]) AS c FROM levels""",
)
fragment(
    "fitted",
    "varying",
    sql=f"""SELECT k.series_id, k.realisation, k.idx, any_value(k.x) AS x, s.comp, coalesce(sum(k.c) FILTER (WHERE
    CASE WHEN k.is_residual OR k.comp >= {FITTED - 1} THEN {FITTED - 1} ELSE k.comp END = s.comp), 0) AS c
    FROM varying k, range({FITTED}) s(comp) GROUP BY k.series_id, k.realisation, k.idx, s.comp""",
)


@query(
    "fit_components",
    sql=using(
        "fitted",
        select="""SELECT series_id, realisation, CAST(comp AS INTEGER) AS comp, count(*) AS n, round(avg(c), 2) + CAST(0 AS DOUBLE) AS mean,
    round(stddev_pop(c), 2) + CAST(0 AS DOUBLE) AS std, count(*) FILTER (WHERE c = 0) = count(*) AS is_padding FROM fitted GROUP BY 1, 2, 3""",
    ),
)
def fit_components_q(spark, folder):
    fitted = fit_components(varying_depth(spark, folder), FITTED, ["series_id", "realisation"])
    return fitted.groupBy("series_id", "realisation", "comp").agg(
        F.count(F.lit(1)).alias("n"),
        (F.round(F.avg("c"), 2) + 0.0).alias("mean"),
        (F.round(F.stddev_pop("c"), 2) + 0.0).alias("std"),
        (F.count_if(F.col("c") == 0) == F.count(F.lit(1))).alias("is_padding"),
    )


@query(
    "ensemble_mean",
    sql=using(
        "fitted",
        select=f"""SELECT series_id, CAST(comp AS INTEGER) AS comp, count(*) AS n, round(avg(c), 2) AS mean, round(stddev_pop(c), 2) AS std FROM (
    SELECT series_id, idx, comp, CASE WHEN comp = {FITTED - 1} THEN x - (sum(c) OVER (PARTITION BY series_id, idx) - c) ELSE c END AS c
    FROM (SELECT series_id, idx, comp, any_value(x) AS x, avg(c) AS c FROM fitted GROUP BY 1, 2, 3)) GROUP BY 1, 2""",
    ),
)
def ensemble_mean_q(spark, folder):
    wide = ensemble_mean(varying_depth(spark, folder), walk(spark, folder), FITTED, REALISATIONS)
    parts = F.array(*[F.struct(F.lit(j).alias("comp"), F.col(f"c{j}").alias("c")) for j in range(FITTED)])
    return wide.select("series_id", F.inline(parts)).groupBy("series_id", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 2).alias("mean"), F.round(F.stddev_pop("c"), 2).alias("std")
    )


@query(
    "ensemble_mean_uncorrected",
    sql=using(
        "varying",
        select="""SELECT series_id, round(max(abs(total - x)), 2) AS recon_max_err,
    round(max(abs(total - x)) * 100 / (max(x) - min(x)), 6) AS recon_pct_of_range FROM (
    SELECT series_id, idx, any_value(x) AS x, sum(c) AS total FROM (
    SELECT series_id, idx, comp, any_value(x) AS x, avg(c) AS c FROM varying GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def ensemble_mean_uncorrected(spark, folder):
    found = uncorrected_mean_error(varying_depth(spark, folder), walk(spark, folder))
    return rounded(found, 2, recon_pct_of_range=6)


PROBES, PROBE_LEVELS = 5, 4


def probes(spark, folder):
    """Five copies of each series with noise that depends on position and copy alone, each a series of its own."""
    rows = walk(spark, folder).select("series_id", "idx", "x")
    copies = with_totals(rows, [F.stddev_pop("x").alias("spread")]).drop("block").withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(PROBES - 1))))
    noise = (F.col("idx").cast("long") * F.col("idx") * 7919 + F.col("realisation") * 104729 + F.col("idx") * 31) % 1009 / 1009.0 - 0.5
    return copies.select(F.concat_ws("#", "series_id", "realisation").alias("series_id"), "idx", (F.col("x") + noise * F.col("spread") * 0.2).alias("x"))


fragment(
    "probes",
    "walk",
    sql=f"""SELECT series_id || '#' || r AS series_id, idx,
    x + ((CAST(idx AS BIGINT) * idx * 7919 + r * 104729 + idx * 31) % 1009 / CAST(1009 AS DOUBLE) - 0.5) * spread * 0.2 AS x FROM (
    SELECT *, stddev_pop(x) OVER (PARTITION BY series_id) AS spread FROM walk), range({PROBES}) p(r)""",
)
_source = "probes"
for _level in range(PROBE_LEVELS):
    fragment(f"q{_level}", _source, sql=f"SELECT *, rest AS h FROM {_source}" if _level else "SELECT series_id, idx, x, x AS rest, x AS h FROM probes")
    _declare_pass(f"qp{_level}", f"q{_level}", "h")
    _source = f"probed{_level}"
    fragment(
        _source,
        f"qp{_level}_env",
        sql=f"""SELECT * EXCLUDE (h, upper, lower) REPLACE (rest - (h - (upper + lower) / 2) AS rest), rest AS r{_level} FROM qp{_level}_env""",
    )


@query(
    "common_depth",
    sql=using(
        _source,
        select=f"""SELECT split_part(series_id, '#', 1) AS series_id, CAST(greatest(max(n_levels + 1), 3) AS INTEGER) AS depth,
    CAST(sum(tops) AS BIGINT) AS tops, CAST(sum(lows) AS BIGINT) AS lows FROM (SELECT series_id,
    {" + ".join("CAST(" + " AND ".join(f"t{k} >= 4 AND b{k} >= 4" for k in range(j + 1)) + " AS INTEGER)" for j in range(PROBE_LEVELS))} AS n_levels,
    {" + ".join(f"t{j}" for j in range(PROBE_LEVELS + 1))} AS tops, {" + ".join(f"b{j}" for j in range(PROBE_LEVELS + 1))} AS lows FROM (SELECT series_id,
    {", ".join(f"count(*) FILTER (WHERE r{j} > p{j} AND r{j} > a{j}) AS t{j}, count(*) FILTER (WHERE r{j} < p{j} AND r{j} < a{j}) AS b{j}" for j in range(PROBE_LEVELS + 1))}
    FROM (SELECT *, {", ".join(f"lag(r{j}) OVER o AS p{j}, lead(r{j}) OVER o AS a{j}" for j in range(PROBE_LEVELS + 1))}
      FROM (SELECT *, rest AS r{PROBE_LEVELS} FROM {_source}) WINDOW o AS (PARTITION BY series_id ORDER BY idx)) GROUP BY 1)) GROUP BY 1""",
    ),
)
def common_depth_q(spark, folder):
    """The depth that five noisy probes of each series show, one pass per level, beside the extrema it rests on."""
    reached = levels_worth_sifting(sift_decompose(probes(spark, folder), PROBE_LEVELS, 1), PROBE_LEVELS)
    parts = F.split("series_id", "#")
    reached = reached.select(parts[0].alias("series_id"), parts[1].alias("realisation"), F.col("n_levels").alias("comp"), "tops", "lows")
    extrema = reached.groupBy("series_id").agg(F.sum("tops").alias("tops"), F.sum("lows").alias("lows"))
    return common_depth(reached).join(extrema, "series_id")


@query("sift_converged")
def sift_converged_q(spark, folder):
    """Sifting of every whole series until it converges; compared with a plain version in the tests."""
    return sift_converged(walk(spark, folder))


@query("ensemble_decompose")
def ensemble_decompose_q(spark, folder):
    """The noise ensemble of every whole series, with the operator's own number of pairs and components."""
    return ensemble_decompose(walk(spark, folder))
