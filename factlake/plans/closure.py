"""Transitive closure by semi-naive iteration from the bound side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage

#: Depth up to which the hops are joined in one plan, without a loop.
UNROLLED = 3


def pairs(edges: DataFrame, ends: DataFrame | None, side: str | None, depth: int | None = None) -> DataFrame:
    """Pairs ``src, dst`` that one hop or more connect, ``depth`` at most; from the ends (column ``x``) on ``side`` only, if given.

    Cycles end when no pair is new. Each round's new pairs are written, so plans do not grow with the depth.
    """
    near, far = ("dst", "src") if side == "dst" else ("src", "dst")
    hops = edges.select(F.col(near).alias("at"), F.col(far).alias("to")).distinct()
    if depth is not None and depth <= 0:
        return edges.limit(0)
    start = hops if ends is None else hops.join(ends.select(F.col("x").alias("at")), "at", "left_semi")
    first = start.select(F.col("at").alias("root"), F.col("to").alias("node"))
    step = hops.withColumnRenamed("at", "node")
    if depth is not None and depth <= UNROLLED:
        found = last = first
        for _ in range(depth - 1):
            last = last.join(step, "node").select("root", F.col("to").alias("node")).distinct()
            found = found.unionByName(last)
        return _named(found.distinct(), near, far)
    step = stage(step)
    frontier = stage(first)
    found, n = frontier, 1
    while (depth is None or n < depth) and not frontier.isEmpty():
        new = frontier.join(step, "node").select("root", F.col("to").alias("node")).distinct()
        frontier = stage(new.join(found, ["root", "node"], "left_anti"))
        found, n = found.unionByName(frontier), n + 1
    return _named(found, near, far)


def _named(found: DataFrame, near: str, far: str) -> DataFrame:
    return found.select(F.col("root").alias(near), F.col("node").alias(far)).select("src", "dst")
