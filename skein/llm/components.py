"""Connected components of an edge table, by large and small stars; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

SALTS = 8  # places where the edges of one node meet its least neighbour


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges joined to least (one row a node) on a; a hub's edges are dealt by their other end, so no task holds them all."""
    dealt = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(dealt, ["a", "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (a, b): each node that isn't the smallest of its component, with the smallest.
    Raises an error if `max_rounds` rounds (more than any graph of 2 ** 60 nodes is known to need) don't settle it."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    for _ in range(max_rounds):
        two = e.groupBy("a").count().where("count > 1").limit(1).count()
        if not two and not e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
            return e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _met(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _met(large, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
