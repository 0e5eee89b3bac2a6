"""Table reads and the per-session memo of derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_memo: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remembered(
    spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """Keep a derived table for the life of the session (read-if-built).

    The table stays distributed; blocks lost with an executor are recomputed.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _memo:
        _memo[key] = build(spark, folder).persist(StorageLevel.MEMORY_AND_DISK)
    return _memo[key]


def forget(spark: SparkSession) -> None:
    """Release every remembered table of this session."""
    for key in [k for k in _memo if k[0] == spark.sparkContext.applicationId]:
        _memo.pop(key).unpersist()


def use_all_cores(df: DataFrame) -> DataFrame:
    """Redistribute rows when the files give fewer input splits than there are cores.

    For work that costs far more per row than moving the row.  A table with enough
    splits is left as it is, without a shuffle.  Meant for plain table reads, whose
    number of splits is known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
