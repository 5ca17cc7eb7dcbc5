"""Connected components of a graph given by its edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.storage import materialize, measured_joins


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of the edges (a, b): the smallest node it is connected with.

    Alternating large-star and small-star steps: each node links its larger
    neighbours, then its smaller ones, to its smallest neighbour. The smallest
    neighbour is an aggregate that is combined before the shuffle, and it comes
    back to the edges by a plain join, whose large keys Spark can split; so a
    node with very many neighbours is no single task's work. Each step is
    written, and few are needed. Null nodes and loops have no effect.
    """
    with measured_joins(edges.sparkSession):
        now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b")
        now = materialize(now.distinct(), name)
        before, state = None, _fingerprint(now)
        while state != before:
            # large star: a > b; what is larger than a node goes to its smallest neighbour or itself
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            # small star: a node and its smaller neighbours go to the smallest of these
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
            before, state = state, _fingerprint(now)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
