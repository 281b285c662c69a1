"""Connected components by alternating large-star and small-star steps, each two equi-joins and a minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _minimum_of_neighbours(both: DataFrame) -> DataFrame:
    """(u, m): u's smallest neighbour, u itself included.  A partial minimum comes before the shuffle, so hubs don't gather."""
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _mirror(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _mirror(edges)
    linked = both.join(_minimum_of_neighbours(both), "u")
    return linked.where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` has u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(low, "u")
    moved = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: two numbers to the driver."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component_id) of every node that an edge touches; component_id is the smallest id reachable.

    ``edges`` has two columns of one orderable type, a row per link in either direction; loops and repeats do no harm,
    nulls link nothing.  Rounds are logarithmic in the longest chain; each is staged, so lineage stays short.  Raises
    RuntimeError where ``rounds`` don't suffice.
    """
    a, b = edges.columns[:2]
    now = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now = stage(now, "edges")
    before = _state(now)
    while before[0]:
        now = stage(_small_star(_large_star(now)), "star")
        after = _state(now)
        if after == before:
            break
        before, rounds = after, rounds - 1
        if not rounds:
            raise RuntimeError("components are not finished in the rounds allowed")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return found.union(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
