import pytest
from pyspark.sql import functions as F

from tidewatch.sources import sinks


@pytest.fixture
def windows(spark):
    rows = [(s, p, c, i, float(i + c)) for s in "ABC" for p in ("full_series", "walk_forward") for c in (0, 1) for i in range(5)]
    return spark.createDataFrame(rows, "series_id string, protocol string, comp int, idx int, y double")


def test_dataset_round_trip_and_pruning(spark, windows, tmp_path):
    path = str(tmp_path / "windows")
    sinks.write_dataset(windows, path)
    assert sorted(sinks.read_dataset(spark, path).select(*windows.columns).collect()) == sorted(windows.collect())
    some = sinks.read_dataset(spark, path, "walk_forward", ["B"])
    assert {(r.series_id, r.protocol) for r in some.collect()} == {("B", "walk_forward")}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(protocol" in plan and "xxhash64" not in plan
    assert sinks.matching(windows, "forward_A").select("series_id").distinct().count() == 1


def test_parts_are_replaced_unit_by_unit(spark, windows, tmp_path):
    path = str(tmp_path / "parts")
    parts = windows.withColumnRenamed("y", "p").withColumn("model", F.lit("lag1"))
    sinks.write_parts(parts, path, buckets=2)
    again = parts.where((F.col("series_id") == "A") & (F.col("comp") == 1)).withColumn("p", F.lit(-1.0))
    sinks.write_parts(again, path, buckets=2)
    stored = spark.read.parquet(path)
    assert stored.count() == parts.count()
    assert stored.where("p = -1").count() == 10
    assert stored.where("p = -1").select("series_id", "comp").distinct().collect() == [("A", 1)]


def test_replace_keeps_the_earlier_version(spark, windows, tmp_path):
    root = str(tmp_path / "table")
    first = sinks.replace_table(windows, root)
    second = sinks.replace_table(windows.limit(3), root)
    assert first.endswith("v000001") and second.endswith("v000002")
    assert sinks.read_table(spark, root).count() == 3
    assert sinks.read_table(spark, root, "v000001").count() == windows.count()
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, str(tmp_path / "nothing"))


def test_result_json(spark, windows, tmp_path):
    path = str(tmp_path / "result")
    sinks.write_result(windows, path)
    assert spark.read.json(path).count() == windows.count()


def test_stored_tables_follow_their_inputs(spark, windows, tmp_path):
    source, root, built = str(tmp_path / "source"), str(tmp_path / "store"), []

    def build(session=spark):
        built.append(1)
        return session.read.parquet(source).groupBy("series_id").count()

    windows.write.parquet(source)
    first = sinks.read_or_build(spark, root, "counts", [source], build)
    other = spark.newSession()
    again = sinks.read_or_build(other, root, "counts", [source], lambda: build(other))  # another session reads what is stored
    assert len(built) == 1 and sorted(first.collect()) == sorted(again.collect())
    windows.limit(3).write.mode("append").parquet(source)
    assert sinks.read_or_build(spark, root, "counts", [source], build).agg({"count": "sum"}).first()[0] == windows.count() + 3
    assert len(built) == 2
