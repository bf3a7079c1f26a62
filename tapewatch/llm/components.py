"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import cut_lineage


def _thin(df: DataFrame, parts: int | None) -> DataFrame:
    return df.coalesce(parts) if parts else df


def _large_star(edges: DataFrame, parts: int | None) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _thin(_thin(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), parts).distinct(), parts)


def _small_star(edges: DataFrame, parts: int | None) -> DataFrame:
    # Every edge points from the larger to the smaller node.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    stars = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v")
    return _thin(_thin(stars, parts).distinct(), parts)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two edges out, or edges out and in; if none has, the edges are stars and every root is the smallest node of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v`` of type long): the smallest node that it reaches.

    Ends when a round changes nothing; each round writes its edges to the shared checkpoint folder. Self-edges and
    repeated edges are ignored; no edges give no rows. ``parts`` bounds the tasks and files of a step, for tables that are small
    beside what the session's shuffle partitions are made for; such a table is tested for stars, which saves the round that changes nothing.
    """
    edges = cut_lineage(_thin(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), parts))
    while parts and _unsettled(edges):
        edges = cut_lineage(_small_star(_large_star(edges, parts), parts))
    before = (0,) if parts else _digest(edges)
    while before[0]:
        edges = cut_lineage(_small_star(_large_star(edges, parts), parts))
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(_thin(edges.select(F.col("v"), F.col("v")).distinct(), parts))
