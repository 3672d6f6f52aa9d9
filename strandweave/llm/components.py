"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large star (``both``): link each larger neighbour to the least of a node's neighbourhood; else small star."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = around.join(least, "a")
    if both:
        return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 40, put: Callable[[DataFrame, str], DataFrame] = land) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): component is the least node that is reachable.

    Each round is landed (by ``put``) and compared with the one before by count and hash; only those two numbers come to the driver.
    Loops and repeated edges do no harm; nulls must not occur. An empty table gives an empty one."""
    now = put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        got = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if mark == (got["n"], got["h"]) or not got["n"]:
            break
        mark = got["n"], got["h"]
        now = put(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
