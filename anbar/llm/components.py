"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anbar.llm.common import written


def _smallest(edges: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the smallest of u and of all its v."""
    mins = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(mins, "u")


def _larger_to_smallest(edges: DataFrame) -> DataFrame:
    """Large star: the larger neighbours of each node are linked to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _smallest(both).where("v > u and v <> m")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """Small star: each node and its smaller neighbours are linked to the smallest of them."""
    found = _smallest(edges)
    ends = F.explode(F.array("u", "v")).alias("u")
    return found.select(ends, F.col("m").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node with a link: the smallest id it reaches.

    Alternating large and small stars until nothing changes; about log2 of the longest path
    rounds. Only sums and minima per node are taken, so a hub with very many links is never
    gathered; its rows of the join are spread by adaptive skew handling. Each round is written
    to the shared folder.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    stars = written(edges.where(F.col(a) != F.col(b)).select(high, low).distinct())
    before, now = None, _state(stars)
    while now != before:
        stars = written(_smaller_to_smallest(_larger_to_smallest(stars)))
        before, now = now, _state(stars)
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
