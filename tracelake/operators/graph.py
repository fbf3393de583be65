"""Bounded traversal of an edge table by simple paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.sources.stored import stored

MOST_DEPTH = 10


def traverse(edges: DataFrame, starts: DataFrame, least: int, most: int, direction: str = "out") -> DataFrame:
    """edges (src, dst, edge_id); starts (node). A row a path of `least` to `most` edges: root, node,
    depth, edge_id (the last edge), path (array of nodes), cycle. A step back onto the path ends there
    with cycle true and is not followed. Each depth is one join on the node reached, over the depth before,
    which is stored: no depth is computed twice."""
    if not 0 <= least <= most <= MOST_DEPTH:
        raise EngineError("invalid_parameter", f"depth is 0 to {MOST_DEPTH}")
    forth = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("edge_id").alias("_edge"))
    back = edges.select(F.col("dst").alias("_at"), F.col("src").alias("_to"), F.col("edge_id").alias("_edge"))
    steps = {"out": forth, "in": back, "both": forth.unionByName(back)}.get(direction)
    if steps is None:
        raise EngineError("invalid_parameter", direction)
    here = starts.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("edge_id"), F.array("node").alias("path"), F.lit(False).alias("cycle"))
    levels = [here]
    for depth in range(1, most + 1):
        met = levels[-1].where(~F.col("cycle")).join(steps, F.col("node") == F.col("_at"))
        levels.append(stored(met.select("root", F.col("_to").alias("node"), F.lit(depth).cast("long").alias("depth"), F.col("_edge").alias("edge_id"), F.concat("path", F.array("_to")).alias("path"), F.array_contains("path", F.col("_to")).alias("cycle"))))
    return reduce(DataFrame.unionByName, levels[least:])
