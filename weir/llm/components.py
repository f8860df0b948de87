"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, write


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: what a node sees (above itself, or below) is tied to the least it sees.

    The least one is an aggregate with partial sums; the join that brings it back has
    plain shuffles on both sides, so that a node with very many edges can be split.
    """
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    seen = edges.unionByName(turned) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable), for the nodes of ``edges`` (columns u and v) but the least ones themselves.

    Rounds go on until a round changes nothing; every round is written to the shared
    folder and the one before it deleted. Edges with a null end are left out.
    """
    spark = edges.sparkSession
    path, seen = fresh_path(spark, "edges"), None
    write(edges.select("u", "v").where("u <> v").distinct(), path)
    while True:
        now = spark.read.parquet(path)
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if sums == seen or not sums[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, old, path = sums, path, fresh_path(spark, "edges")
        write(_star(_star(now, True), False), path)
        drop_path(spark, old)
