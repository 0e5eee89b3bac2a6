"""Repair of a delivered dataset: gates first, then a commit.

Delivered windows live in a versioned table. A repair stages the merged table as a version that nobody sees yet, runs the
gates on the files it has staged, and publishes them only then:

* reproduction: rows the fault doesn't touch must come out of the recomputation as they were delivered;
* alignment: every window must end at the row before its target;
* targets: added-up component targets must equal the series.

A dataset that fails a gate keeps its delivered rows. The record of a repair is committed with the version; a dataset
named in it is not repaired again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.quality import DATASET, patch_odd_rows, reproduction_difference, target_agreement, window_alignment
from tidewatch.session import cut_lineage
from tidewatch.sources import sinks

REPRODUCED = 1e-5
PATCHED, DONE, CONFLICT = "patched", "patched before", "superseded"


def repair_gates(delivered: DataFrame, staged: DataFrame, recomputed: DataFrame, series: DataFrame, everything: bool = False, tolerance: float = REPRODUCED) -> DataFrame:
    """Per dataset: what each gate measured, and ``refused``: the gates that failed, empty if none did.

    With ``everything`` all rows are recomputed, so they need not be reproduced.
    """
    keys = list(DATASET)
    before = window_alignment(delivered, series).select(*keys, "rows", F.col("lag0").alias("lag0_before"), F.col("lag1").alias("lag1_before"))
    after = window_alignment(staged, series).select(
        *keys, F.col("rows").alias("rows_after"), F.col("lag0").alias("lag0_after"), F.col("lag1").alias("lag1_after"), "window_recon_max_pct"
    )
    targets = target_agreement(staged, series).select(*keys, F.col("agrees").alias("targets_agree"))
    same = reproduction_difference(delivered, recomputed).select(*keys, F.col("n").alias("n_reproduced"), "max_rel_diff")
    gates = before.join(after, keys, "left").join(targets, keys, "left").join(same, keys, "left")
    failed = {
        "reproduction": F.lit(False) if everything else ~F.coalesce(F.col("max_rel_diff") <= tolerance, F.lit(False)),
        "alignment": ~F.coalesce(F.col("lag1_after") == 0, F.lit(False)),
        "targets": ~F.coalesce("targets_agree", F.lit(False)),
        "rows": F.coalesce("rows_after", F.lit(0)) < F.col("rows"),
    }
    return gates.withColumn("refused", F.concat_ws(",", *[F.when(found, F.lit(name)) for name, found in failed.items()]))


def _named(datasets: Sequence[Mapping[str, str]], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(d[k] for k in DATASET) for d in datasets], ", ".join(f"{k} string" for k in DATASET))


def repair_table(
    root: str, recomputed: DataFrame, series: DataFrame, everything: bool = False, tolerance: float = REPRODUCED, publish: bool = True
) -> DataFrame:
    """Repair the table at ``root``; per dataset the gates' findings and the ``outcome``, and the current ``version``.

    Outcomes: patched; refused, with the gates; patched before; superseded, if another writer committed while the gates ran (nothing
    is published then); with ``publish`` off, ``would patch``. Datasets without recomputed rows are left alone.
    """
    spark = recomputed.sparkSession
    base = sinks.current_version(spark, root)
    delivered = sinks.read_table(spark, root)
    earlier = sinks.version_record(spark, root, base).get("patched", [])
    done = _named(earlier, spark)
    fresh = recomputed.join(done, list(DATASET), "left_anti")
    open_ = delivered.join(cut_lineage(fresh.select(*DATASET).distinct()), list(DATASET), "left_semi")

    # A claimed version that is not committed is seen by no reader.
    version = sinks.claim_version(spark, root)
    merged = patch_odd_rows(open_, fresh, everything)
    placed = f"{root}/{version}"
    columns = [F.col(c).cast(t) for c, t in delivered.dtypes]
    rest = delivered.where(F.col("split") != "test").unionByName(
        delivered.where(F.col("split") == "test").join(open_.select(*DATASET).distinct(), list(DATASET), "left_anti")
    )
    merged.select(*columns).unionByName(rest.select(*columns)).write.mode("error").parquet(placed)
    staged = spark.read.parquet(placed)
    gates = cut_lineage(repair_gates(open_, staged, fresh, series, everything, tolerance))

    # One row per dataset.
    accepted = [r.asDict() for r in gates.where("refused = ''").select(*DATASET).collect()]
    refused = gates.where("refused <> ''").select(*DATASET)
    committed = False
    if accepted and publish:
        if not refused.isEmpty():  # those keep what was delivered: a version of its own, staged as before
            version = sinks.claim_version(spark, root)
            kept = staged.join(refused, list(DATASET), "left_anti").unionByName(delivered.join(refused, list(DATASET), "left_semi").select(*columns))
            kept.write.mode("error").parquet(f"{root}/{version}")
        record = {"patched": [*earlier, *accepted], "mode": "all" if everything else "odd", "tolerance": tolerance}
        committed = sinks.commit_version(spark, root, version, record, base=base)
    return _outcomes(gates, done.join(delivered.select(*DATASET).distinct(), list(DATASET), "left_semi"), publish, committed).withColumn(
        "version", F.lit(sinks.current_version(spark, root))
    )


def _outcomes(gates: DataFrame, done: DataFrame, publish: bool, committed: bool) -> DataFrame:
    good = F.lit(PATCHED if committed else CONFLICT if publish else "would patch")
    outcome: Column = F.when(F.col("refused") == "", good).otherwise(F.concat(F.lit("refused: "), "refused"))
    told = gates.withColumn("outcome", outcome).drop("refused")
    return told.unionByName(done.withColumn("outcome", F.lit(DONE)), allowMissingColumns=True)
