"""Plan shape and group sizes that keep the jobs distributable."""

from pyspark.sql import functions as F

from tests import brute
from tidewatch.operators.baselines import benchmark_forecasts
from tidewatch.operators.blocks import spread
from tidewatch.operators.quality import expected_origins
from tidewatch.plans import QUERIES


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_hot_series_is_split_into_bounded_groups(spark):
    df, pdf = brute.make_series(spark, (9000, 100, 80))
    sizes = spread(df, before=40, after=16, block_rows=256).groupBy("series_id", "block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 256 + 40 + 16
    rows = benchmark_forecasts(df, block_rows=256)
    lanes = [w for w in executed(rows).splitlines() if "windowspecdefinition" in w]
    assert lanes and all("series_id" in w and "block" in w for w in lanes)
    assert rows.count() == sum(n - 30 - int(0.8 * (n - 30)) for n in (9000, 100, 80))


def test_expected_origins_cover_the_test_part(spark):
    df, _ = brute.make_series(spark, (500, 61))
    got = expected_origins(df, block_rows=37).collect()
    assert sorted(got) == sorted(df.where("idx >= train_end").select("series_id", F.col("idx").alias("origin")).collect())


def test_flagship_reads_the_table_once_and_only_the_needed_columns(spark, folder):
    plan = executed(QUERIES["baselines_scoreboard"](spark, folder))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 1
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in scans[0]
    assert "IsNotNull(l_returnflag)" in scans[0].split("PushedFilters")[1]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan


def test_native_queries_stay_in_the_jvm_and_avoid_cross_joins(spark, folder):
    for name in ("protocol_walk_forward", "leakage_inflation", "window_alignment", "recover_index", "ngram_overlap"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Cross" not in plan, name


def test_lineage_is_cut_in_the_named_folder(spark, tmp_path):
    from tidewatch.session import cut_lineage

    before = spark.sparkContext.getCheckpointDir()
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and spark.sparkContext.getCheckpointDir() is not None
    assert before is None or before == spark.sparkContext.getCheckpointDir()
    assert spark.sparkContext.getCheckpointDir().rsplit("/", 1)[1] in df.inputFiles()[0]
    assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()
