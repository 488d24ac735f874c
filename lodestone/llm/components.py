"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a Spark aggregation over the links; the links stay in durable tables and none
reach the driver. Stars bound the work to the number of links a round, also in chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (large: the higher, small: the lower and itself) to its smallest neighbour."""
    ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    joined = ways.join(low, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """(doc, label): for every node of the links (a, b) the smallest node of its component."""
    edges = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        before, edges = edges, durable(_star(_star(edges, large=True), large=False), "edges")
        drop_durable(before)
        # done when every node has one smaller neighbour that has none itself
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
        if ends.filter("up > 1 or up = 1 and all > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("doc"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("doc"), F.col("b").alias("label"))).distinct()
