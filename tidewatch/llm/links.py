"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import few, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b) reaches; roots themselves are left out.

    Alternates two steps that hang every node's neighbours on its least neighbour, first the
    larger ones, then the smaller ones, until nothing changes; each round is written, and no round
    holds more links than there were. Null ends are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b")
    most = links.count()
    edges = stored(few(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), most))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(few(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), most))
        # Done when all are stars: every node hangs on one other, and on none that hangs itself.
        ends = edges.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
        ends = ends.unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
