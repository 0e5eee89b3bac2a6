"""Round trips: what the sinks write, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.centred import decompose_centred, long_components
from tidewatch.plans.inputs import COMPONENTS, walk
from tidewatch.plans.registry import query, using
from tidewatch.session import shared_folder
from tidewatch.sources import sinks


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"


def _components(spark: SparkSession, folder: str) -> DataFrame:
    rows = long_components(decompose_centred(walk(spark, folder)), COMPONENTS)
    return rows.select("series_id", F.lit("full_series").alias("protocol"), "comp", "idx", "c")


def _summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_id", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("c"), 4).alias("least"), F.round(F.max("c"), 4).alias("most")
    )


_SUMMARY = "series_id, CAST(comp AS INTEGER) AS comp, count(*) AS n, round(min(c), 4) AS least, round(max(c), 4) AS most"


@query("dataset_round_trip", sql=using("comps", select=f"SELECT {_SUMMARY} FROM comps WHERE series_id IN ('A_High', 'N_Low') GROUP BY 1, 2"))
def dataset_round_trip(spark, folder):
    """A dataset written by protocol and series, of which two series are read."""
    path = _place(spark)
    sinks.write_dataset(_components(spark, folder), path)
    return _summary(sinks.read_dataset(spark, path, "full_series", ["A_High", "N_Low"]))


@query("parts_round_trip", sql=using("comps", select=f"SELECT {_SUMMARY} FROM (SELECT * REPLACE (CASE WHEN comp = 2 THEN -c ELSE c END AS c) FROM comps) GROUP BY 1, 2"))
def parts_round_trip(spark, folder):
    """Parts of which one component is delivered again with the opposite sign."""
    path, parts = _place(spark), _components(spark, folder).withColumn("model", F.lit("lag1"))
    sinks.write_parts(parts, path)
    sinks.write_parts(parts.where("comp = 2").withColumn("c", -F.col("c")), path)
    return _summary(spark.read.parquet(path))


@query(
    "version_round_trip",
    sql=using(
        "comps",
        select="""SELECT 'current' AS version, count(*) FILTER (WHERE comp < 3) AS n, round(max(c) FILTER (WHERE comp < 3), 4) AS most FROM comps
    UNION ALL SELECT 'v000001', count(*), round(max(c), 4) FROM comps""",
    ),
)
def version_round_trip(spark, folder):
    """A table replaced by a smaller version; the earlier one stays readable."""
    root, rows = _place(spark), _components(spark, folder)
    sinks.replace_table(rows, root)
    sinks.replace_table(rows.where("comp < 3"), root)
    both = [("current", sinks.read_table(spark, root)), ("v000001", sinks.read_table(spark, root, "v000001"))]
    told = [t.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("c"), 4).alias("most")).withColumn("version", F.lit(v)) for v, t in both]
    return told[0].unionByName(told[1])


@query("result_round_trip", sql=using("comps", select=f"SELECT {_SUMMARY} FROM comps GROUP BY 1, 2"))
def result_round_trip(spark, folder):
    """A result table as JSON lines."""
    path = _place(spark)
    found = _summary(_components(spark, folder))
    sinks.write_result(found, path)
    return spark.read.schema(found.schema).json(path)


@query(
    "stored_series",
    sql=using(
        "walk",
        select="""SELECT series_id, count(*) AS n, round(min(x), 2) AS least, round(max(x), 2) AS most, CAST(0 AS BIGINT) AS built_again FROM walk GROUP BY 1""",
    ),
)
def stored_series(spark, folder):
    """The level series stored by the fingerprint of the table they come from; asked for twice, built once."""
    built = []

    def build():
        built.append(1)
        return walk(spark, folder)

    root = _place(spark)
    for _ in range(2):
        rows = sinks.read_or_build(spark, root, "walk", [f"{folder}/lineitem.parquet"], build)
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 2).alias("least"), F.round(F.max("x"), 2).alias("most"), F.lit(len(built) - 1).cast("long").alias("built_again")
    )
