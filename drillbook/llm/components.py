"""Connected components of a graph given by its edges, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def tied(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (a, b) but the smallest of each component, which names it.

    Large-star and small-star steps in turn: each node's larger neighbours,
    then its smaller ones, are tied to its smallest neighbour, until every edge
    ends in the smallest node of its component. Edges never become more than
    the input and minima are taken in every task first. All edges of a node
    meet its minimum in one task, or more where Spark can split it. Each round is a
    written table, of which only the last is kept; it is the result. The first
    reads `edges` twice, which may repeat and hold self-loops.
    """

    def ways(of: DataFrame) -> DataFrame:
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        return of.select(F.explode(both).alias("way")).select("way.a", "way.b")

    now, number = edges.where("a != b"), 0
    while True:
        pairs = ways(now)
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("of"), F.least("a", "m").alias("m")
        )
        large = (
            pairs.join(least, F.col("a") == F.col("of"))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
        joined = large.join(least, F.col("a") == F.col("of"))
        small = (
            joined.select(
                F.explode(
                    F.array(
                        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    )
                ).alias("edge")
            )
            .select("edge.a", "edge.b")
            .where("a != b")
            .distinct()
        )
        number += 1
        now = scratch.write(small, f"{name}-{number}")
        if number > 1:
            scratch.drop(f"{name}-{number - 1}")
        ends = now.select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("node"), F.lit(1).alias("up")),
                    F.struct(F.col("b").alias("node"), F.lit(0).alias("up")),
                )
            ).alias("end")
        )
        seen = ends.groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
        open_nodes = seen.where("ups > 1 OR ups = 1 AND least = 0")
        if open_nodes.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), also of self-loops; a component is its smallest node."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(tied(edges.distinct(), scratch, name), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
