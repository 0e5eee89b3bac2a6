"""Sifting to convergence, the ensemble around it, and the contract of the kernels."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from tidewatch.operators.decompose import COLUMNS, decompose, reconstruction
from tidewatch.operators import ensemble
from tidewatch.operators.ensemble import antithetic_realisations, ensemble_decompose, ensemble_mean, fit_components, probe_realisations, probed_depth
from tidewatch.operators.prepare import synthetic_series
from tidewatch.operators.sift import sift_converged


def wavy(n, seed):
    """Whole-valued steps around two waves of unlike length."""
    steps = np.random.default_rng(seed).integers(-12, 13, n).cumsum()
    return steps + np.round(90 * np.cos(np.arange(n) / 5.0) + 300 * np.sin(np.arange(n) / 31.0))


def sifted(x, levels=10, tolerance=0.2, least=0.01):
    rest, parts = x.astype(float), []
    for level in range(levels + 1):
        inner = rest[1:-1]
        tops = int(((inner > rest[:-2]) & (inner > rest[2:])).sum())
        lows = int(((inner < rest[:-2]) & (inner < rest[2:])).sum())
        if min(tops, lows) < 4 or rest.std() <= least * x.std() or level == levels:
            return [*parts, rest]
        h, change = rest, 1.0
        while change >= tolerance:
            top, low = brute.envelopes(h)
            was, h = h, h - (top + low) / 2
            change = ((h - was) ** 2).sum() / (was**2).sum()
        parts.append(h)
        rest = rest - h
    return parts


@pytest.fixture(scope="module")
def series(spark):
    rows = [(s, i, float(v), 400, 326) for k, s in enumerate("ab") for i, v in enumerate(wavy(400, k))]
    return spark.createDataFrame(rows, "series_id string, idx int, x double, n int, train_end int").cache()


@pytest.mark.parametrize("block_rows", [64, 1024])
def test_sifting_converges_like_the_plain_version(spark, block_rows):
    lengths = {"long": 700, "mid": 150, "short": 5}
    rows = [(s, i, float(v)) for k, (s, n) in enumerate(lengths.items()) for i, v in enumerate(wavy(n, k))]
    out = sift_converged(spark.createDataFrame(rows, "series_id string, idx int, x double"), block_rows=block_rows).toPandas()
    for k, (s, n) in enumerate(lengths.items()):
        want, own = sifted(wavy(n, k)), out[out.series_id == s]
        assert own.comp.nunique() == len(want) and own.converged.all()
        for comp, part in enumerate(want):
            got = own[own.comp == comp].sort_values("idx")
            assert got.c.to_numpy() == pytest.approx(part, abs=1e-6) and (got.is_residual == (comp == len(want) - 1)).all()


def test_limits_are_reported(spark, series):
    out = sift_converged(series, levels=1, tolerance=1e-9, most_passes=2)
    assert {(r.comp, r.is_residual, r.converged) for r in out.select("comp", "is_residual", "converged").distinct().collect()} == {(0, False, False), (1, True, False)}


def test_ensemble_keeps_every_row_and_adds_up(spark):
    rows = [(s, i, float(v)) for s, n in (("a", 300), ("five", 5)) for i, v in enumerate(wavy(n, 3))]
    df = spark.createDataFrame(rows, "series_id string, idx int, x double")
    out = ensemble_decompose(df, count=4, pairs=2).toPandas()
    assert len(out) == 305 and np.abs(out[[f"c{j}" for j in range(4)]].sum(axis=1) - out.x).max() < 1e-6
    runs = antithetic_realisations(df, 2).toPandas()
    mine = [sifted(g.sort_values("idx").v.to_numpy(), levels=3) for _, g in runs[runs.series_id == "a"].groupby("realisation")]
    fast = np.mean([m[0] for m in mine], axis=0)
    assert out[out.series_id == "a"].sort_values("idx").c0.to_numpy() == pytest.approx(fast, abs=1e-6)


def test_probed_depth_is_that_of_the_deepest_probe(spark, series):
    lone = spark.createDataFrame([("five", i, float(v), 5, 4) for i, v in enumerate(wavy(5, 3))], series.schema)
    both = series.unionByName(lone)
    probes = probe_realisations(both, 2).cache()
    found = sift_converged(probes, ["series_id", "realisation"], "v", levels=4).select("series_id", "realisation", "comp").distinct().collect()
    count = Counter((r.series_id, r.realisation) for r in found)
    want = {s: max(3, *(count[s, k] for k in range(2))) for s in ("a", "b", "five")}
    assert {r.series_id: r.depth for r in probed_depth(both, 2, levels=4).collect()} == want and want["five"] == 3 < want["a"]
    other = probe_realisations(both, 2, seed=2)
    assert other.join(probes.withColumnRenamed("v", "u"), ["series_id", "idx", "realisation"]).where("abs(u - v) < 1e-9").count() < 5


def test_ensemble_of_the_probed_depth(spark, series, monkeypatch):
    """Every series has as many components as its probes show; zeros stand before the residual of the others."""
    depths = spark.createDataFrame([("a", 3), ("b", 5)], "series_id string, depth int")
    monkeypatch.setattr(ensemble, "probed_depth", lambda *args, **options: depths)
    out = ensemble_decompose(series, None, 1, most_passes=3).toPandas()
    parts = [f"c{j}" for j in range(5)]
    assert np.abs(out[parts].sum(axis=1) - out.x).max() < 1e-6
    a, b = out[out.series_id == "a"], out[out.series_id == "b"]
    assert (a[["c2", "c3"]] == 0).all(axis=None) and a.c4.std() > 0 and (b[parts].std() > 0).all()


def test_noise_is_reproducible_antithetic_and_scaled(series):
    runs = antithetic_realisations(series, 3, seed=5).cache()
    again = antithetic_realisations(series.repartition(7), 3, seed=5)
    def values(df):
        return {(r.series_id, r.idx, r.realisation): r.v for r in df.collect()}

    first, second, other = values(runs), values(again), values(antithetic_realisations(series, 3, seed=6))
    assert all(first[k] == pytest.approx(second[k], rel=1e-12) for k in first)
    assert sum(abs(first[k] - other[k]) > 1e-6 for k in first) == len(first)
    means = runs.groupBy("series_id", "idx").agg(F.avg("v").alias("m"), F.max("x").alias("x"))
    assert means.agg(F.max(F.abs(F.col("m") - F.col("x")))).first()[0] < 1e-9
    fixed = antithetic_realisations(series, 50, noise_std=0.2, relative=False)
    assert fixed.agg(F.stddev_pop(F.col("v") - F.col("x"))).first()[0] == pytest.approx(0.2, rel=0.05)


@pytest.mark.parametrize("count", [3, 4, 5, 7])
def test_fit_components_keeps_row_sums(spark, count):
    rows = [(f"r{k}", j, j == k - 1, i, float((j + 1) * 10**j + i)) for k in (2, 4, 6) for j in range(k) for i in range(3)]
    df = spark.createDataFrame(rows, "series_id string, comp int, is_residual boolean, idx int, c double")
    out = fit_components(df, count, ["series_id"])
    assert out.count() == 9 * count
    sums = out.groupBy("series_id", "idx").agg(F.sum("c").alias("s"))
    wanted = df.groupBy("series_id", "idx").agg(F.sum("c").alias("t"))
    assert sums.join(wanted, ["series_id", "idx"]).where("s != t").count() == 0
    short = out.where("series_id = 'r2' and idx = 0").orderBy("comp").collect()
    assert [r.c for r in short] == [1.0] + [0.0] * (count - 2) + [20.0]


def test_ensemble_mean_counts_missing_levels_as_zero(spark):
    rows = [("s", 0, 0, 0, False, 6.0), ("s", 0, 0, 1, True, 94.0), ("s", 0, 1, 0, False, 2.0), ("s", 0, 1, 1, False, 8.0), ("s", 0, 1, 2, True, 90.0)]
    df = spark.createDataFrame(rows, "series_id string, idx int, realisation int, comp int, is_residual boolean, c double")
    signal = spark.createDataFrame([("s", 0, 100.0)], "series_id string, idx int, x double")
    r = ensemble_mean(df, signal, 3, 2).first()
    assert (r.c0, r.c1, r.c2) == (4.0, 4.0, 92.0)


def test_every_kernel_honours_the_contract(spark, series):
    for kernel, options, tolerance in (
        ("centred", {}, 1e-9), ("linear_sift", {"levels": 2, "passes": 1}, 1e-9), ("sift", {}, 1e-9), ("ensemble", {"pairs": 1, "count": 3}, 1e-9),
    ):
        comps = decompose(series, kernel, **options)
        assert tuple(comps.columns) == COLUMNS
        found = reconstruction(comps, series).collect()
        assert len(found) == 2 and all(r.n == 400 and r.recon_pct_of_range < tolerance for r in found), kernel
    own = decompose(series, lambda s: s.select("series_id", "idx", F.lit(0).alias("comp"), F.lit(True).alias("is_residual"), F.col("x").alias("c")))
    assert all(r.recon_max_err == 0 and r.n_components == 1 for r in reconstruction(own, series).collect())


def test_synthetic_series(series):
    made = synthetic_series(series, walk_std=3.0, noise_std=2.0).where("series_id = 'a'").toPandas().sort_values("idx")
    t = np.arange(400)
    assert (made["fast"] + made["slow"] + made["trend"]).to_numpy() == pytest.approx(made["x"].to_numpy())
    assert np.std(made["fast"] - 10 * np.sin(2 * np.pi * t / 9)) == pytest.approx(2.0, rel=0.15)
    assert np.std(np.diff(made["trend"] - 5000 - 0.5 * t)) == pytest.approx(3.0, rel=0.15)


def test_registered_ensemble_is_whole(spark, folder, monkeypatch):
    """The query overrides none of the operator's numbers of pairs and components."""
    from tidewatch.plans import sifted

    given = []
    monkeypatch.setattr(sifted, "ensemble_decompose", lambda series, **options: given.append((series.count(), options)))
    sifted.ensemble_decompose_q(spark, folder)
    assert given == [(sifted.walk(spark, folder).count(), {})]
