"""Checks and repair on small datasets with known faults."""

import pytest
from pyspark.sql import functions as F

from tests import brute
from tidewatch.operators.protocols import full_series_windows, walk_forward_windows
from tidewatch.operators.quality import (
    dataset_check,
    drop_counts,
    dropped_origins,
    expected_origins,
    manifest,
    part_settings_check,
    patch_odd_rows,
    patch_report,
    pending_units,
    ready_datasets,
    reconcile_claims,
    reproduction_difference,
    target_agreement,
    target_copy_fraction,
    window_alignment,
    with_patch_record,
)


@pytest.fixture(scope="module")
def made(spark):
    df, _ = brute.make_series(spark, (120, 91))
    good = walk_forward_windows(df).cache()
    bad = walk_forward_windows(df, trim_end_to_even=True).cache()
    return df.cache(), good, bad


def test_alignment_copy_and_agreement(made):
    df, good, bad = made
    for r in window_alignment(good, df).collect():
        assert r.lag0 == r.rows and r.lag1 == 0 and r.window_recon_max_pct < 1e-9
    assert all(r.lag1 == r.rows // 2 for r in window_alignment(bad, df).where("series_id = 's0'").collect())
    # Integer steps of equal size make a few component values coincide.
    assert all(r.fraction < 0.05 for r in target_copy_fraction(good).collect())
    assert all(0.4 < r.fraction < 0.6 for r in target_copy_fraction(bad).collect())
    assert all(r.agrees for r in target_agreement(good, df).collect())
    assert not any(r.agrees for r in target_agreement(bad, df).collect())


def test_patch_repairs_and_is_idempotent(made):
    df, good, bad = made
    patched = patch_odd_rows(bad, good).cache()
    report = patch_report(bad, patched, df).collect()
    assert all(r.saved and r.lag1_before > 0 and r.lag1_after == 0 for r in report)
    columns = ["series_id", "protocol", "comp", "idx", "w", "y", "x"]
    once = sorted(patched.select(columns).collect())
    assert sorted(patch_odd_rows(patched, good).select(columns).collect()) == once
    assert sorted(good.where("split = 'test'").select(columns).collect()) == once
    assert not any(r.saved for r in patch_report(bad, bad.where("split = 'test'"), df).collect())
    assert all(r.max_rel_diff == 0 for r in reproduction_difference(bad, good).collect())


def test_patch_keeps_rows_missing_on_either_side(made):
    _, good, bad = made
    merged = patch_odd_rows(bad.where("idx != 110"), good.where("idx != 105"), everything=True)
    assert merged.where("series_id = 's0' and idx in (105, 110)").select("idx").distinct().count() == 2


@pytest.mark.parametrize("stride", [1, 4, 50])
def test_stride_reuses_the_latest_refit(made, stride):
    df, good, _ = made
    test = {(r.series_id, r.comp, r.idx): r for r in good.where("split = 'test'").collect()}
    rows = walk_forward_windows(df, stride=stride, block_rows=16).where("split = 'test'").collect()
    assert len(rows) == len(test)
    for r in rows:
        refit = r.test_start + stride * ((r.idx - r.test_start) // stride)
        assert r.w == pytest.approx(test[r.series_id, r.comp, refit].w) and r.y == pytest.approx(test[r.series_id, r.comp, r.idx].y)


def test_manifest_and_readiness(made):
    df, good, bad = made
    full = full_series_windows(df, trim_newest=1)
    rows = {(r.series_id, r.protocol): r for r in manifest(good.unionByName(full)).collect()}
    r = rows[("s0", "walk_forward")]
    assert (r.n, r.test_start, r.n_components, r.n_train_windows, r.n_test_windows) == (120, 102, 6, 72, 18)
    assert (r.test_index_first, r.test_index_last, r.n_test_dropped) == (102, 119, 0)
    assert rows[("s0", "full_series")].test_index_last == 118
    mixed = full.unionByName(good.where("series_id = 's0'")).unionByName(bad.where("series_id = 's1'"))
    ready = ready_datasets(with_patch_record(manifest(mixed), window_alignment(mixed, df)))
    assert sorted((r.series_id, r.protocol) for r in ready.collect()) == [("s0", "full_series"), ("s0", "walk_forward"), ("s1", "full_series")]


def test_clean_data_has_no_violations_and_dropped_origins_are_listed(made):
    df, good, _ = made
    rows = good.unionByName(full_series_windows(df))
    assert dataset_check(rows, df, 6).agg(F.sum("violations")).first()[0] == 0
    kept = good.where("split = 'test' and comp = 0 and idx not in (104, 110)").select("series_id", F.col("idx").alias("origin"))
    assert sorted(r.origin for r in dropped_origins(expected_origins(df), kept).collect() if r.series_id == "s0") == [104, 110]
    assert {r.series_id: r.n_dropped for r in drop_counts(expected_origins(df), kept).collect()}["s0"] == 2


def test_units_settings_and_claims(spark):
    datasets = spark.createDataFrame([("a", "full_series", 2)], "series_id string, protocol string, n_components int")
    done = spark.createDataFrame([("a", "full_series", "m1", 0)], "series_id string, protocol string, model string, comp int")
    left = [(r.model, r.comp) for r in pending_units(datasets, ["m1", "m2"], done).collect()]
    assert left == [("m1", 1), ("m2", 0), ("m2", 1)]
    parts = spark.createDataFrame(
        [("a", "p", "m", 0, "x", 1), ("a", "p", "m", 1, "y", 1), ("b", "p", "m", 0, "x", 1)],
        "series_id string, protocol string, model string, comp int, scaling string, seed int",
    )
    got = {r.series_id: (r.n_missing, r.mixed, r.refused) for r in part_settings_check(parts, 2, ["scaling", "seed"]).collect()}
    assert got == {"a": (0, "scaling", True), "b": (1, "", True)}
    claims = spark.createDataFrame([("a", 1, 7.2), ("b", 1, 7.2), ("c", 0, 8.0)], "k string, digits int, written double")
    computed = spark.createDataFrame([("a", 7.1637), ("b", 7.31)], "k string, computed double")
    assert {r.k: r.ok for r in reconcile_claims(claims, computed, ["k"]).collect()} == {"a": True, "b": False, "c": False}
