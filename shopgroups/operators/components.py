"""Connected components of an edge table, and tables stored between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Spark's setting by which a query's shuffle files go when it ends, not at some later garbage collection of the driver.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, frees its shuffles' disk."""
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(_SWEEP, None)
    conf.set(_SWEEP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(_SWEEP, before) if before else conf.unset(_SWEEP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b, any order); root is the smallest node reachable.

    Alternating large-star and small-star steps: every node hands its neighbours on to its smallest
    neighbour, so hot nodes become stars in a logarithmic number of rounds. Each step is a group-by
    minimum and a join; each round is written to ``folder``.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "round-0")
    last, n = None, 0
    while (mark := _mark(edges)) != last:
        last, n = mark, n + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), folder, f"large-{n}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), folder, f"round-{n}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
