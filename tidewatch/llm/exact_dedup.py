"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then the full hash.

Each step looks only at rows that still share everything compared so far with another
row; the full text is hashed for those alone (or for all rows, when the caller wants
every digest). What is joined back are tables of groups with two members or more,
broadcast only when their counted rows are few.

Defined cases: null text equals empty text; of equal texts the row with the largest id
stays (a null id is smaller than any); of rows that repeat that id too, one stays; an empty
table gives an empty result; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.rows import sized, stored


def repeated_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """A stored table of the groups of equal texts with two rows or more.

    (n_bytes, sha256, group_size, keep_id, tied): ``tied`` counts the rows with the id that stays.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text"))
    lengths = stored(rows.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes"))
    rows = rows.join(sized(lengths), "n_bytes", "left_semi").withColumn("prefix", F.xxhash64(F.left("text", F.lit(prefix_chars))))
    prefixes = stored(rows.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes", "prefix"))
    rows = rows.join(sized(prefixes), ["n_bytes", "prefix"], "left_semi").withColumn("sha256", F.sha2("text", 256))
    by_id = rows.groupBy("n_bytes", "sha256", "id").agg(F.count("*").alias("n"))
    best = F.max(F.struct("id", "n"))  # a null id comes before any other
    groups = by_id.groupBy("n_bytes", "sha256").agg(F.sum("n").alias("group_size"), best.alias("best"))
    return stored(
        groups.where("group_size > 1").select("n_bytes", "sha256", "group_size", F.col("best.id").alias("keep_id"), F.col("best.n").alias("tied"))
    )


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "exact", every_digest: bool = False) -> DataFrame:
    """``docs`` with a struct column ``out``: keep_id, group_size, kept, sha256.

    ``sha256`` is null for texts that are known to be single unless ``every_digest``.
    """
    groups = repeated_groups(docs, id_col, text_col)
    text, own_id = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`")
    rows = docs.withColumn(out, F.struct(F.octet_length(text).alias("n_bytes"), F.sha2(text, 256).alias("sha256")))
    groups = groups.select(F.struct(*groups.columns).alias(f"{out}_group"))
    group, found = F.col(f"`{out}_group`"), F.col(f"`{out}`")
    rows = rows.join(
        sized(groups), (group["n_bytes"] == found["n_bytes"]) & (group["sha256"] == found["sha256"]), "left"
    )
    single = group.isNull()
    first = single | own_id.eqNullSafe(group["keep_id"])
    tied = F.coalesce(group["tied"], F.lit(1)) > 1
    verdict = F.struct(
        F.when(single, own_id).otherwise(group["keep_id"]).alias("keep_id"),
        F.coalesce(group["group_size"], F.lit(1)).cast("long").alias("group_size"),
        first.alias("kept"),
        (found["sha256"] if every_digest else F.when(~single, found["sha256"])).alias("sha256"),
    )
    rows = rows.withColumn(out, verdict).withColumn(f"{out}_tied", first & tied).drop(f"{out}_group")
    if not groups.where(group["tied"] > 1).isEmpty():
        # Rows that repeat the id that stays: one of each such set stays. Only these rows are ranked.
        ranked = rows.where(F.col(f"{out}_tied")).withColumn(
            f"{out}_rank", F.row_number().over(Window.partitionBy(F.col(out)["sha256"], own_id).orderBy(F.lit(0)))
        )
        ranked = ranked.withColumn(out, F.col(out).withField("kept", F.col(f"{out}_rank") == 1)).drop(f"{out}_rank")
        rows = rows.where(~F.col(f"{out}_tied")).unionByName(ranked)
    return rows.drop(f"{out}_tied")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    return exact_copies(docs, id_col, text_col, "_exact").where("_exact.kept").drop("_exact")
