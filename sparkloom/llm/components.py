"""Connected components of a graph given as edges, by rounds of contraction; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import sized, staged


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (columns u, v of one type; each link once, either way round).

    Each round joins every node to the neighbour, itself included, that a fresh random order puts first, and replaces both
    ends of each edge. A component never comes apart and shrinks by a constant factor in expectation, chains too, so the
    rounds grow with the logarithm of the largest component. Only nodes with links take part; the minimum per node is
    pre-aggregated, so a node with very many links is no hot key. ``root`` is some node of the component, the same for all its nodes.

    Edge cases: loops and repeated edges are harmless; null ends are ignored; no edges give no rows.
    """
    links = staged(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "links")
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    found = staged(nodes.select("node", F.col("node").alias("root")), "roots")
    for i in range(max_rounds):
        if links.isEmpty():
            return found
        order = lambda c, i=i: F.struct(F.xxhash64(F.col(c), F.lit(i)).alias("h"), F.col(c).alias("x"))
        both = links.select("u", "v").union(links.select("v", "u"))
        hooks = both.groupBy("u").agg(F.least(F.min(order("v")), F.min(order("u")))["x"].alias("to"))
        hooks = sized(staged(hooks, "hooks"))
        ends = links.join(hooks.select(F.col("u"), F.col("to").alias("a")), "u").select("a", "v")
        ends = ends.join(hooks.select(F.col("u").alias("v"), F.col("to").alias("b")), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        links = staged(ends.where("u <> v").distinct(), "links")
        found = staged(found.join(hooks.select(F.col("u").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
