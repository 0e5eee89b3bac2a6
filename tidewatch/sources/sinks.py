"""Dataset, part and result tables on shared storage."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.blocks import home_block
from tidewatch.session import cut_lineage

SERIES_BUCKETS = 64
UNIT = ("series_id", "protocol", "model", "comp")


def series_bucket(series_id: Column, buckets: int = SERIES_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(series_id), F.lit(buckets)).cast("int")


def write_dataset(rows: DataFrame, path: str, buckets: int = SERIES_BUCKETS) -> None:
    """Windows or components as Parquet, partitioned by protocol and series bucket.

    Writers are spread by block as well, so a hot series is written by many tasks;
    rows are sorted so that row groups can be skipped by series and component.
    """
    placed = rows.withColumns({"series_bucket": series_bucket(F.col("series_id"), buckets), "_block": home_block()})
    (
        placed.repartition("protocol", "series_bucket", "_block")
        .sortWithinPartitions("protocol", "series_bucket", "series_id", "comp", "idx")
        .drop("_block")
        .write.mode("overwrite")
        .partitionBy("protocol", "series_bucket")
        .parquet(path)
    )


def read_dataset(
    spark: SparkSession,
    path: str,
    protocol: str | None = None,
    series_ids: Sequence[str] = (),
    buckets: int = SERIES_BUCKETS,
) -> DataFrame:
    """Read a dataset back; protocol and series filters prune partitions."""
    rows = spark.read.parquet(path)
    if protocol is not None:
        rows = rows.where(F.col("protocol") == protocol)
    if series_ids:
        wanted = [series_bucket(F.lit(s), buckets) for s in series_ids]
        rows = rows.where(F.col("series_bucket").isin(wanted)).where(F.col("series_id").isin(list(series_ids)))
    return rows.drop("series_bucket")


def matching(rows: DataFrame, text: str, columns: Sequence[str] = ("protocol", "series_id")) -> DataFrame:
    """Datasets whose ``protocol_series`` tag contains ``text``."""
    return rows.where(F.concat_ws("_", *columns).contains(text))


def write_parts(parts: DataFrame, path: str, buckets: int = SERIES_BUCKETS) -> None:
    """Store component forecasts unit by unit; a unit written again replaces its earlier rows.

    Only the partitions the new units fall into are rewritten.  They are staged and
    swapped at commit, so a half-written unit is never taken for a finished one.
    """
    spark = parts.sparkSession
    fresh = parts.withColumn("series_bucket", series_bucket(F.col("series_id"), buckets))
    if _exists(spark, path):
        earlier = spark.read.schema(fresh.schema).parquet(path)
        touched = fresh.select("protocol", "model", "series_bucket").distinct()
        kept = earlier.join(touched, ["protocol", "model", "series_bucket"], "left_semi").join(
            fresh.select(*UNIT).distinct(), list(UNIT), "left_anti"
        )
        # Written apart first: what is read must not be what is being replaced.
        fresh = cut_lineage(fresh.unionByName(kept))
    (
        fresh.withColumn("_block", home_block())
        .repartition("protocol", "model", "series_bucket", "comp", "_block")
        .drop("_block")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("protocol", "model", "series_bucket")
        .parquet(path)
    )


def write_result(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A result table as JSON lines or Parquet."""
    rows.write.mode("overwrite").format(kind).save(path)


def replace_table(rows: DataFrame, root: str) -> str:
    """Write a new version next to the old ones, then commit it.  Returns the new version's path.

    Readers see the old version or the new one; earlier versions stay as backups.
    """
    version = claim_version(rows.sparkSession, root)
    rows.write.mode("error").parquet(f"{root}/{version}")
    commit_version(rows.sparkSession, root, version)
    return f"{root}/{version}"


def read_table(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The current version of a table written by ``replace_table``, or a named earlier one."""
    chosen = version or current_version(spark, root)
    if chosen is None:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.parquet(f"{root}/{chosen}")


def claim_version(spark: SparkSession, root: str) -> str:
    """Reserve the next version number of a table for one writer.

    A number belongs to whoever creates its claim file, which must not exist before; two writers can't both
    create it.  The token in it tells apart writers on stores that notice an existing file late.
    """
    token = uuid.uuid4().hex
    taken = [int(name[1:7]) for name in _listed(spark, f"{root}/_claims")]
    number = max(taken, default=0) + 1
    while not (_created(spark, f"{root}/_claims/v{number:06d}", token) and _content(spark, f"{root}/_claims/v{number:06d}") == token):
        number += 1
    return f"v{number:06d}"


def commit_version(spark: SparkSession, root: str, version: str, record: Mapping[str, object] | None = None, base: str | None = None) -> bool:
    """Make a written version visible, with a record of how it came about.

    With ``base``, only if no other version was committed since; else nothing is published and the result is False.
    """
    if base is not None and current_version(spark, root) != base:
        return False
    entry = {"version": version, "base": base, **(record or {})}
    return _created(spark, f"{root}/_log/{version}.json", json.dumps(entry, sort_keys=True))


def current_version(spark: SparkSession, root: str) -> str | None:
    """The newest committed version."""
    return max((name[:7] for name in _listed(spark, f"{root}/_log")), default=None)


def version_record(spark: SparkSession, root: str, version: str) -> dict:
    """What was recorded when a version was committed."""
    return json.loads(_content(spark, f"{root}/_log/{version}.json"))


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """What identifies the present content of files and folders: every file's path, size and time of change."""
    told = []
    for path in paths:
        files, target = _files(spark, path)
        found = files.listFiles(target, True)
        while found.hasNext():
            one = found.next()
            told.append(f"{one.getPath()}:{one.getLen()}:{one.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()[:32]


def read_or_build(spark: SparkSession, root: str, name: str, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that is stored under ``root`` and read from there until one of its ``inputs`` changes.

    It is found by the fingerprint of the inputs, so any session that shares ``root`` reads what another has
    stored. Tables of earlier contents stay beside it. Two sessions that build it at once store two versions of the same rows.
    """
    place = f"{root}/{name}-{fingerprint(spark, inputs)}"
    if current_version(spark, place) is None:
        replace_table(build(), place)
    return read_table(spark, place)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _listed(spark: SparkSession, path: str) -> list[str]:
    files, target = _files(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []
    return [name for name in names if name.startswith("v")]


def _created(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file unless there is one."""
    files, target = _files(spark, path)
    try:
        out = files.create(target, False)
    except Py4JJavaError:
        if files.exists(target):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def _content(spark: SparkSession, path: str) -> str:
    """A small file's first line."""
    return spark.read.text(path).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
