"""Connected components by alternating stars, on DataFrame joins with every round staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage, work_dir


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least node next to it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node, and its smaller neighbours, are sent to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every node of ``edges`` (a, b: long).

    Self-links and repeated edges do no harm; no edges give no rows. Each round is written to the shared folder,
    so a lost executor costs a round's tasks at most.
    """
    spark = edges.sparkSession
    oriented = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    where = work_dir(spark)
    now = stage(oriented, where)

    def print_of(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = print_of(now)
    while before[0]:
        at = work_dir(spark)
        after = stage(_small_star(_large_star(now)), at)
        drop_stage(spark, where)
        where, now = at, after
        if (mark := print_of(now)) == before:
            break
        before = mark
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
