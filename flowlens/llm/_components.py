"""Connected components by repeated random contraction; nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._shared import written


def components(edges: DataFrame) -> DataFrame:
    """Maps every node of edges (a long, b long, both directions or one) to one label for each component.

    In each round a node points at that one of itself and its neighbours with the least hash (another hash each
    round, so long paths shrink by a fraction too), and the edges between the nodes pointed at make the next
    round. Each round is written to the shared folder. Self-loops, repeated and empty edges are harmless.
    """
    edges = edges.where("a is not null and b is not null")
    edges = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    maps: list[DataFrame] = []
    while True:
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("node"))
        parents = edges.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a")))["node"].alias("parent"))
        maps.append(written(parents.withColumnRenamed("a", "node"), "parents"))
        ends = maps[-1]
        moved = (
            edges.where("a < b")
            .join(ends.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
            .join(ends.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
            .where("pa <> pb")
        )
        edges = written(moved.select(F.explode(F.array(F.struct(F.col("pa").alias("a"), F.col("pb").alias("b")), F.struct(F.col("pb").alias("a"), F.col("pa").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
        if edges.isEmpty():
            break
    label = maps[-1].select("node", F.col("parent").alias("component"))
    for step in reversed(maps[:-1]):
        label = step.join(label.withColumnRenamed("node", "parent"), "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    return written(label, "components")
