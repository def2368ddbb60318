"""Connected components of a link table by repeated contraction; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.workspace import materialise


def _order(name: str):
    """Ids in an order that has nothing to do with their values, so that long chains shrink by a constant factor a round."""
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("id"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each id of a link with the smallest id that it reaches.

    Each round joins every id to the first of its neighbours and itself in a hashed order and renames the links by
    that; a star ends in two rounds, a chain in about log2 of its length. Null ends and links of an id
    to itself are ignored; no links give an empty result.
    """
    edges = materialise(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    roots = materialise(ends.withColumn("root", F.col("id")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(_order("b")).alias("m"))
        to = materialise(first.select(F.col("a").alias("root"), F.least(F.col("m"), _order("a"))["id"].alias("to")), "parents")
        roots = materialise(roots.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
        left = edges.join(to.select(F.col("root").alias("a"), F.col("to").alias("ta")), "a")
        moved = left.join(to.select(F.col("root").alias("b"), F.col("to").alias("tb")), "b")
        edges = materialise(moved.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    best = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(best, "root").select("id", "component")
