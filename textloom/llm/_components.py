"""Connected components of a table of links, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """links (a, b, of one type) to (node, root): nodes have one root just when links connect them.

    Each round every node joins the neighbour with the least hash, of its own for the round; links are carried over to
    what their ends joined, and the ends meet in a few rounds, also along chains. The minimum is a partial aggregate,
    so a node with very many links is no hot key there. Only whether links are left goes to the driver.
    """
    current = materialise(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    joined: list[DataFrame] = []
    while not current.isEmpty():
        seed = F.lit(len(joined))
        order = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("n"))
        ends = current.select(F.col("a").alias("node"), F.least(order("a"), order("b")).alias("to")).union(current.select(F.col("b"), F.least(order("a"), order("b"))))
        step = materialise(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.col("to.n").alias("root")), "joined")
        joined.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("root").alias(f"to_{c}")) for c in "ab")
        moved = current.join(left, "a").join(right, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        current = materialise(moved.filter("a != b").distinct(), "links")
    if not joined:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = joined[0]
    for step in joined[1:]:
        roots = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots
