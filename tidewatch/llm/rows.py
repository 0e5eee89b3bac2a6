"""Small helpers shared by the operators: columns, checked broadcasts, written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

#: A side with at most so many rows of a few numbers each may be broadcast (some 20 MB); above it, joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows with whole texts that a Python task is handed at once, at most.
TEXT_ROWS = 1024
#: Rows of a few numbers, or of two texts, that a task writes at least, if there are so many; each file costs an executor some processes on a local file system.
FILE_ROWS, FILE_TEXTS = 8192, 1024


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns in use, so that other columns can't clash; null text becomes empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, no lineage."""
    return cut_lineage(df)


def stored_in_batches(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """``df`` stored, while its Python tasks get at most ``rows`` rows at once (fewer where the session says so).

    So neither they nor the executor beside them hold a partition's texts. The session's setting is as before afterwards.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(conf.get(name))
    if 0 < before <= rows:
        return stored(df)
    conf.set(name, rows)
    try:
        return stored(df)
    finally:
        conf.set(name, before)


def few(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more partitions than one for every ``each`` of them.

    So small tables aren't strewn over as many files as a shuffle has partitions; partitions grow in number with the rows.
    """
    return df.coalesce(max(1, -(-rows // each)))


def sized(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a *stored* table only when its counted rows are few; else leave the join to shuffle.

    Counting reads nothing but the footers of the stored files.
    """
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, is ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder
