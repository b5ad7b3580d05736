"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins over the edges; a node's edges are never gathered
in one row, so a hub is split like any skewed join. The number of rounds grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(low, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node with an edge can reach.

    Nulls and self loops are dropped, repeated and reversed edges count once, no edges give no rows.
    """
    spark = edges.sparkSession
    cur = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b")
    seen, old = None, None
    while True:
        path = scratch(spark, "stars")
        step = _star(cur, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        _star(step, False).write.parquet(path)
        cur = spark.read.schema("a long, b long").parquet(path)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if old:
            drop_path(spark, old)
        if now == seen or not now[0]:
            break
        seen, old = now, path
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
