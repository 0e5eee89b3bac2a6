"""Repairs that are published only when every gate holds, and versions that belong to one writer."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tests import brute
from tidewatch.operators import repair
from tidewatch.operators.protocols import walk_forward_windows
from tidewatch.operators.quality import window_alignment
from tidewatch.sources import sinks


@pytest.fixture(scope="module")
def made(spark):
    df, _ = brute.make_series(spark, (120, 91))
    return df.cache(), walk_forward_windows(df).cache(), walk_forward_windows(df, trim_end_to_even=True).cache()


@pytest.fixture
def delivered(made, tmp_path):
    root = str(tmp_path / "delivered")
    sinks.replace_table(made[2], root)
    return root


def _rows(df):
    return sorted(df.select("series_id", "protocol", "comp", "idx", "split", "w", "y", "x").collect())


def test_a_repair_is_published_and_recorded(spark, made, delivered):
    df, good, bad = made
    found = repair.repair_table(delivered, good, df).collect()
    assert {(r.series_id, r.outcome, r.lag1_after, r.version) for r in found} == {(s, "patched", 0, "v000002") for s in ("s0", "s1")}
    assert all(r.lag1_before > 0 and r.max_rel_diff == 0 and r.targets_agree for r in found)
    assert _rows(sinks.read_table(spark, delivered)) == _rows(good)
    assert _rows(sinks.read_table(spark, delivered, "v000001")) == _rows(bad)  # the backup
    record = sinks.version_record(spark, delivered, "v000002")
    assert sorted(d["series_id"] for d in record["patched"]) == ["s0", "s1"] and record["base"] == "v000001" and record["mode"] == "odd"
    again = repair.repair_table(delivered, good, df).collect()
    assert {r.outcome for r in again} == {"patched before"} and {r.version for r in again} == {"v000002"}


def test_a_refused_dataset_keeps_its_rows(spark, made, delivered):
    df, good, bad = made
    off = good.withColumn("w", F.when(F.col("series_id") == "s1", F.transform("w", lambda v: v * 1.01)).otherwise(F.col("w")))
    outcome = {r.series_id: r.outcome for r in repair.repair_table(delivered, off, df).collect()}
    assert outcome["s0"] == "patched" and outcome["s1"].startswith("refused: reproduction")
    held = sinks.read_table(spark, delivered)
    assert _rows(held.where("series_id = 's1'")) == _rows(bad.where("series_id = 's1'"))
    assert _rows(held.where("series_id = 's0'")) == _rows(good.where("series_id = 's0'"))
    # what was refused can be repaired later, what was patched is left alone
    later = {r.series_id: r.outcome for r in repair.repair_table(delivered, good, df).collect()}
    assert later == {"s0": "patched before", "s1": "patched"}
    assert _rows(sinks.read_table(spark, delivered)) == _rows(good)


def test_gates_look_at_what_was_staged(spark, made, delivered):
    df, good, bad = made
    missing = {r.series_id: r.outcome for r in repair.repair_table(delivered, bad, df).collect()}  # recomputed with the same fault
    assert all(o.startswith("refused: ") and "alignment" in o for o in missing.values())
    assert sinks.current_version(spark, delivered) == "v000001"
    looked = repair.repair_table(delivered, good, df, publish=False).collect()
    assert {r.outcome for r in looked} == {"would patch"} and sinks.current_version(spark, delivered) == "v000001"
    everything = repair.repair_table(delivered, good.withColumn("w", F.col("w")), df, everything=True).collect()
    assert {r.outcome for r in everything} == {"patched"}


def test_datasets_without_recomputed_rows_are_left_alone(spark, made, delivered):
    df, good, bad = made
    found = repair.repair_table(delivered, good.where("series_id = 's0'"), df).collect()
    assert [(r.series_id, r.outcome) for r in found] == [("s0", "patched")]
    assert _rows(sinks.read_table(spark, delivered).where("series_id = 's1'")) == _rows(bad.where("series_id = 's1'"))


def test_a_commit_in_between_supersedes_a_repair(spark, made, delivered, monkeypatch):
    df, good, bad = made
    gates = repair.repair_gates

    def slow(*args):
        sinks.replace_table(bad.where("series_id = 's0'"), delivered)
        return gates(*args)

    monkeypatch.setattr(repair, "repair_gates", slow)
    assert {r.outcome for r in repair.repair_table(delivered, good, df).collect()} == {"superseded"}
    assert {r.series_id for r in sinks.read_table(spark, delivered).select("series_id").distinct().collect()} == {"s0"}


def test_two_writers_never_share_a_version(spark, tmp_path):
    root = str(tmp_path / "table")
    with ThreadPoolExecutor(8) as pool:
        claimed = list(pool.map(lambda _: sinks.claim_version(spark, root), range(16)))
        assert sorted(claimed) == [f"v{k:06d}" for k in range(1, 17)]
        written = list(pool.map(lambda k: sinks.replace_table(spark.range(k), root), range(1, 5)))
    assert sorted(w[-7:] for w in written) == [f"v{k:06d}" for k in range(17, 21)]
    assert sinks.read_table(spark, root).count() == 1 + written.index(max(written))
    assert not sinks.commit_version(spark, root, "v000020")  # committed once
    assert not sinks.commit_version(spark, root, "v000001", base="v000000") and sinks.commit_version(spark, root, "v000016", base="v000020")


def test_alignment_of_an_uncommitted_version_is_seen_by_nobody(spark, made, delivered):
    df, good, _ = made
    version = sinks.claim_version(spark, delivered)
    good.write.parquet(f"{delivered}/{version}")
    assert window_alignment(sinks.read_table(spark, delivered), df).agg(F.sum("lag1")).first()[0] > 0
