"""Connected components of an edge table, wholly distributed.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014) turn the edges into stars around each component's least node in a logarithmic
number of rounds. Each step is a partial aggregate, which is written, and an equi-join with an
exchange on either side, which adaptive execution can split, so that a node with very many links does
not have to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Edges for each partition; a table of fewer edges is one partition, and its steps need no exchange.
PARTITION_EDGES = 100_000


def _both(a: str, b: str, c: str, d: str) -> list[Column]:
    """Two edges (a, b) and (c, d) from one row; unlike a union, this keeps a single partition single."""
    return [F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(c).alias("u"), F.col(d).alias("v")))).alias("e")]


def _star(edges: DataFrame, large: bool, single: bool, scratch: Scratch, name: str) -> DataFrame:
    """edges: (u, v). Links each neighbour of u (large: greater ones; small: u and lesser ones) to the least node around u."""
    if large:
        around = edges.select(*_both("u", "v", "v", "u")).select("e.*")
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    least = least if single else scratch.write(least, name)  # in a single partition nothing has to be split
    linked = around.join(least, "u")
    moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else linked.select(*_both("v", "m", "u", "m")).select("e.*")
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges: (a, b) of one orderable type. Returns (node, root), root the least node reachable; nodes without an edge are left out.

    Loops and repeated edges are harmless; null ends are dropped; an empty table gives an empty table.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        now = now.coalesce(1) if seen and seen[0] <= PARTITION_EDGES else now
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        single = sums[0] <= PARTITION_EDGES
        now = now.coalesce(1) if single else now
        if sums == seen or not sums[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, k = sums, k + 1
        large = _star(now, True, single, scratch, f"{name}-least-large")
        large = large if single else scratch.write(large, f"{name}-large")
        now = scratch.write(_star(large, False, single, scratch, f"{name}-least-small"), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", *([] if single else [f"{name}-least-large", f"{name}-large", f"{name}-least-small"]))
