"""Connected components of a large graph by alternating star contractions.

Each round is two aggregations and two joins over the edges; links and labels stay distributed, and
each round is cut by a table in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import discard, stored


# The driver keeps a thread for every exchange of the last minute, at some 0.7 MB each. So rounds make few: a join does not
# turn into a broadcast on top of the shuffles it has already, rows are made distinct once a round, the first star is
# stored instead of planned three times, and no round is run only to see that nothing changes.


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour. Rows may repeat."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.where("b > a").hint("merge").join(least, "a")
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Expects a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.hint("merge").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def is_star_forest(edges: DataFrame) -> bool:
    """Whether every larger end has one edge only and is no smaller end: nothing is left to contract. Expects a > b."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every node of `edges` (columns a, b); component is the smallest node reachable.

    Loops and null ends are ignored; repeated edges do no harm; no edges give an empty result. The result is
    a stored table; those of the rounds are deleted as soon as the next one stands.
    """
    spark = edges.sparkSession
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(ordered, name)
    while not is_star_forest(current):
        tied = stored(_large_star(current), name)
        discard(current)
        current = stored(_small_star(tied), name)
        discard(tied)
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    found = stored(current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots), name)
    discard(current)
    return found
