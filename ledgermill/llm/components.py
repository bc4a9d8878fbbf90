"""Connected components of a graph of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import stored


def smallest_reachable(links: DataFrame) -> DataFrame:
    """For each node of ``links`` (a, b) with a smaller one in reach: (node, root).

    Every round hooks each node to its least neighbour, follows these hooks to their
    ends by doubling, and replaces the links by those between the ends. A round leaves
    at most half of the nodes; hubs are only ever joined by a unique key on the other
    side and aggregated by minimum, so no node's links are gathered. Rows with null or
    equal ends are ignored; without links the result is empty.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    hooks = None
    while not edges.isEmpty():
        step = _follow(stored(edges.groupBy("a").agg(F.min("b").alias("b"))))
        hooks = step if hooks is None else stored(_moved(hooks, "b", step).unionByName(step))
        moved = _moved(_moved(edges, "a", step), "b", step)
        edges = stored(
            moved.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
    if hooks is None:
        hooks = edges
    return hooks.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _moved(pairs: DataFrame, end: str, hooks: DataFrame) -> DataFrame:
    """``pairs`` with the nodes in column ``end`` replaced by where they hang."""
    to = hooks.select(F.col("a").alias("from_node"), F.col("b").alias("to_node"))
    other = "b" if end == "a" else "a"
    joined = pairs.join(to, pairs[end] == to["from_node"], "left")
    return joined.select(other, F.coalesce("to_node", end).alias(end)).select("a", "b")


def _follow(hooks: DataFrame) -> DataFrame:
    """Each hook led on to the end of its chain; the lengths left halve with each pass."""
    while True:
        to = hooks.select(F.col("a").alias("from_node"), F.col("b").alias("to_node"))
        joined = hooks.join(to, hooks["b"] == to["from_node"], "left")
        nxt = stored(
            joined.select(
                "a",
                F.coalesce("to_node", "b").alias("b"),
                F.col("to_node").isNotNull().alias("moved"),
            )
        )
        hooks = nxt.select("a", "b")
        if nxt.where("moved").isEmpty():
            return hooks
