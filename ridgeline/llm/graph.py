"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import delete_path, write_out


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, root: for each node that has an edge the least node that it reaches.

    Each round aggregates by node with partial sums before the shuffle, joins back (a node with very many edges is
    split by adaptive execution) and is written to the shared folder, which ends the lineage. Rounds grow as the
    square of the logarithm of the longest path. Self-loops, repeats and an empty table are allowed."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = both(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = around.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, path = write_out(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    before = state(now)
    while True:
        new, new_path = write_out(star(star(now, True), False), "edges")
        delete_path(edges.sparkSession, path)
        now, path, after = new, new_path, state(new)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
