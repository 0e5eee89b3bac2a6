"""Noise-assisted ensembles: realisations, depth reconciliation, averaging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, join_totals, with_totals
from tidewatch.operators.sift import sift_converged
from tidewatch.session import cut_lineage


def standard_normal(*parts: Column | str, seed: int = 0) -> Column:
    """A N(0, 1) value that depends only on ``parts`` and ``seed``.

    A recomputed task yields the same noise, which a generator seeded per partition
    would not.
    """
    scale = 2.0**52

    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *parts), F.lit(2**52)) + 0.5) / scale

    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * F.pi() * uniform(2))


def antithetic_realisations(
    series: DataFrame,
    pairs: int,
    noise_std: float = 0.2,
    relative: bool = True,
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``2 * pairs`` noisy copies per row in +w / -w pairs, as ``(realisation, v)``.

    ``noise_std`` is a fraction of the spread of the series, or an absolute amount
    when ``relative`` is off.
    """
    rows = with_totals(series, [F.stddev_pop("x").alias("_spread")], block_rows=block_rows)
    amount = F.greatest(F.col("_spread") * noise_std, F.lit(1e-12)) if relative else F.lit(float(noise_std))
    copies = rows.withColumn("_pair", F.explode(F.sequence(F.lit(0), F.lit(max(1, pairs) - 1))))
    copies = copies.withColumn("_w", amount * standard_normal("series_id", "idx", "_pair", seed=seed))
    signed = F.array(
        *[
            F.struct(
                (F.col("_pair") * 2 + k).alias("realisation"), (F.col("x") + sign * F.col("_w")).alias("v")
            )
            for k, sign in ((0, 1.0), (1, -1.0))
        ]
    )
    return copies.select(*[c for c in series.columns], F.inline(signed))


def probe_realisations(series: DataFrame, probes: int = 5, noise_std: float = 0.2, seed: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``probes`` independent noisy copies per row, as ``(realisation, v)``."""
    rows = with_totals(series, [F.stddev_pop("x").alias("_spread")], block_rows=block_rows).drop("block")
    copies = rows.withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(max(1, probes) - 1))))
    noise = F.greatest(F.col("_spread") * noise_std, F.lit(1e-12)) * standard_normal("series_id", "idx", "realisation", seed=seed)
    return copies.withColumn("v", F.col("x") + noise).drop("_spread")


def common_depth(components: DataFrame, least: int = 3) -> DataFrame:
    """``(series_id, depth)``: the most components that any probe of a series has, the residual included, at least ``least``.

    ``components`` holds ``(series_id, realisation, idx, comp, is_residual, c)``; partial sums per task are one row per probe.
    """
    per_probe = components.groupBy("series_id", "realisation").agg((F.max("comp") + 1).alias("_depth"))
    return per_probe.groupBy("series_id").agg(F.greatest(F.max("_depth"), F.lit(least)).alias("depth"))


def probed_depth(series: DataFrame, probes: int = 5, noise_std: float = 0.2, levels: int = 10, least: int = 3, seed: int = 1, block_rows: int = BLOCK_ROWS, **sifting) -> DataFrame:
    """``common_depth`` of probes that are sifted until they converge, with at most ``levels`` details."""
    noisy = probe_realisations(series, probes, noise_std, seed, block_rows)
    return common_depth(sift_converged(noisy, ["series_id", "realisation"], "v", levels=levels, block_rows=block_rows, **sifting), least)


def fit_components(components: DataFrame, count: int, keys: Sequence[str]) -> DataFrame:
    """Bring every decomposition to ``count`` components without changing any row sum.

    Surplus levels join the residual; missing ones become zeros just before it.
    ``components`` holds ``(keys, idx, comp, is_residual, c)``.
    """
    slot = F.when(F.col("is_residual") | (F.col("comp") >= count - 1), F.lit(count - 1)).otherwise(F.col("comp"))
    placed = components.withColumn("_slot", slot)
    fitted = placed.groupBy(*keys, "idx").agg(
        *[F.coalesce(F.sum(F.when(F.col("_slot") == j, F.col("c"))), F.lit(0.0)).alias(f"c{j}") for j in range(count)]
    )
    parts = F.array(
        *[
            F.struct(F.lit(j).alias("comp"), F.lit(j == count - 1).alias("is_residual"), F.col(f"c{j}").alias("c"))
            for j in range(count)
        ]
    )
    return fitted.select(*keys, "idx", F.inline(parts))


def ensemble_mean(
    realisations: DataFrame, signal: DataFrame, count: int, n_realisations: int, depths: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean component per row over all realisations; the residual absorbs what is left of the signal.

    Each realisation is reconciled to ``count`` levels on the way: a level it lacks
    counts as zero, so dividing the sum by the number of realisations is the mean of
    the zero-padded copies.  With ``depths`` (series_id, depth) a series has only that many components: details
    beyond them stay in its residual, which is last, behind zeros.
    """
    details = [F.when(~F.col("is_residual") & (F.col("comp") == j), F.col("c")) for j in range(count - 1)]
    sums = realisations.groupBy("series_id", "idx").agg(
        *[(F.coalesce(F.sum(d), F.lit(0.0)) / n_realisations).alias(f"c{j}") for j, d in enumerate(details)]
    )
    if depths is not None:
        ends = signal.groupBy("series_id").agg(F.max("idx").alias("_last")).join(depths, "series_id")
        sums = join_totals(sums, ends, "_last", block_rows=block_rows).drop("block")
        sums = sums.withColumns({f"c{j}": F.when(F.col("depth") > j + 1, F.col(f"c{j}")).otherwise(F.lit(0.0)) for j in range(count - 1)}).drop("depth")
    joined = sums.join(signal.select("series_id", "idx", "x"), ["series_id", "idx"])
    residual = F.col("x")
    for j in range(count - 1):
        residual = residual - F.col(f"c{j}")
    return joined.withColumn(f"c{count - 1}", residual)


def uncorrected_mean_error(realisations: DataFrame, signal: DataFrame) -> DataFrame:
    """Reconstruction error when levels are averaged as they come.

    The comparison arm: level k averages the runs that reach it, so a short run's
    residual mixes with other runs' details and the sum no longer telescopes.
    """
    means = realisations.groupBy("series_id", "idx", "comp").agg(F.avg("c").alias("c"))
    total = means.groupBy("series_id", "idx").agg(F.sum("c").alias("_total"))
    off = F.abs(F.col("_total") - F.col("x"))
    joined = total.join(signal.select("series_id", "idx", "x"), ["series_id", "idx"])
    return joined.groupBy("series_id").agg(
        F.max(off).alias("recon_max_err"),
        (F.max(off) * 100 / F.nullif(F.max("x") - F.min("x"), F.lit(0.0))).alias("recon_pct_of_range"),
    )


def ensemble_decompose(
    series: DataFrame, count: int | None = 10, pairs: int = 25, noise_std: float = 0.2, seed: int = 0, block_rows: int = BLOCK_ROWS, **sifting
) -> DataFrame:
    """Noise-assisted sifting: ``(series_id, idx, x, c0 .. c<count - 1>)``, the residual last.

    ``2 * pairs`` noisy copies of every series are sifted until they converge, each on its own, brought
    to ``count`` components and averaged; the residual is what the mean components leave of the series, so no row is lost.
    With no ``count`` every series has the depth that its probes show.
    """
    depths = None
    if count is None:
        depths = cut_lineage(probed_depth(series, noise_std=noise_std, seed=seed + 1, block_rows=block_rows, **sifting))
        count = depths.agg(F.max("depth")).first()[0] or 1
    noisy = antithetic_realisations(series, pairs, noise_std, seed=seed, block_rows=block_rows)
    sifted = sift_converged(noisy, ["series_id", "realisation"], "v", levels=max(count - 1, 1), block_rows=block_rows, **sifting)
    return ensemble_mean(sifted, series, count, 2 * max(1, pairs), depths, block_rows)
