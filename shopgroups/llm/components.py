"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: A group is hot beyond this many rows, and beyond this part of all rows.
HOT_ROWS, HOT_PART = 1_000, 1_000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of their group.

    ``groups`` has one row per group: ``keys``, ``n_rows`` (its rows, dropped here) and others. ``total`` rows
    have fewer than ``HOT_PART`` hot groups, which are broadcast, so that no task takes a hot group's rows.
    """
    hot = F.col("n_rows") > max(HOT_ROWS, total // HOT_PART)
    others = [c for c in groups.columns if c not in keys and c != "n_rows"]
    many = groups.filter(hot).select(*keys, F.struct(*others).alias("_of_group"))
    marked = rows.join(F.broadcast(many), keys, "left")
    found = marked.filter("_of_group is not null").select(*rows.columns, "_of_group.*")
    few = groups.filter(~hot).drop("n_rows")
    return found.unionByName(marked.filter("_of_group is null").drop("_of_group").join(few, keys).select(*rows.columns, *others))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b, any order); root is the smallest node reachable.

    Edges point from the larger to the smaller node. In a round every node first hands its larger neighbours,
    then its other smaller ones, to its smallest neighbour; the rounds end when each node has one smaller
    neighbour that has none itself: only stars are left. Every round is written to ``folder``.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, n = stored(edges, folder, "round-0"), 0
    while not _stars(edges):
        n += 1
        larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        smallest = edges.unionByName(larger).groupBy("a").agg(
            F.least("a", F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n_rows")).filter("n_rows > 0")
        up = with_group(larger, smallest, ["a"], edges.count()).select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = stored(up.distinct(), folder, f"large-{n}")
        low = up.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_rows"))
        down = with_group(up, low, ["a"], up.count()).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(down.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), folder, f"round-{n}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that one none."""
    if edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return False
    return not edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi").limit(1).count()
