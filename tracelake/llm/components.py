"""Connected components of an undirected graph, as joins and group-bys over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root): the smallest node that links reach from each node.

    Each round hangs every node with a smaller neighbour under the smallest one, follows these pointers
    to their ends by doubling, and keeps the links between different ends. At least half of the nodes
    that still have links go each round. Links that repeat or join a node to itself change nothing; a
    link with a null end is passed over. A node without links has no row."""
    both = lambda x: x.select("a", "b").union(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = written(both(links.where("a is not null and b is not null and a <> b")).distinct(), "links")
    label = None  # node -> its end so far
    while not left.isEmpty():
        up = left.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
        up = written(up, "pointers")
        while True:  # pointer doubling
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            doubled = up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            table = written(doubled, "pointers")
            drop_written(up)
            up = table
            if up.where("moved").isEmpty():
                break
        up = up.select("node", "root")
        if label is None:
            label = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            label = written(label.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = lambda x, side: x.join(up.select(F.col("node").alias(side), F.col("root").alias(f"{side}_end")), side)
        rest = ends(ends(left, "a"), "b").where("a_end <> b_end").select(F.col("a_end").alias("a"), F.col("b_end").alias("b")).distinct()
        left = written(rest, "links")
    return label if label is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
