"""Connected components of a graph given by links, without gathering it anywhere.

Large-star and small-star steps alternate (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): first every node's larger neighbours, then its smaller
ones, are linked to the least node around it. When a round changes nothing, every node
hangs on the least node of its component. Rounds grow with the logarithm of the
component's size, and each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.scratch import cut_lineage


def _to_least(links: DataFrame) -> DataFrame:
    """Every link's far end ``v`` beside the least node around its near end ``u``."""
    least = links.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("least"))
    return links.join(least, "u")


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``links(a, b)``; ``root`` is the least node.

    Links from a node to itself, double links and both directions are allowed. Links
    with a null end are left out.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(links.where("a is not null and b is not null and a > b").distinct(), "links")
    before = _signature(edges)
    while before[0]:
        both = edges.selectExpr("a as u", "b as v").union(edges.selectExpr("b as u", "a as v"))
        large = _to_least(both).where("v > u").selectExpr("v as u", "least as v").distinct()
        small = _to_least(large).selectExpr("inline(array(struct(u as a, least as b), struct(v as a, least as b)))")
        edges = cut_lineage(small.where("a > b").distinct(), "links")
        now = _signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.selectExpr("a as node", "b as root").union(roots.selectExpr("node", "node as root"))
