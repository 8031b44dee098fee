"""Connected components over a table of links: a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of links (a, b).

    Each round hooks every node to its smallest neighbour, follows that once more, and
    contracts the links between the roots found; every node that is not the smallest of
    its neighbourhood goes, so the links shrink geometrically. Tables between rounds are
    written to the shared folder. Minima combine before the shuffle, and the joins are
    plain equi-joins whose hot keys (hubs) Spark splits. Links of a node with itself and
    repeated links do nothing; no links give no nodes.
    """
    edges = cut(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    labels = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        parent = cut(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("up")), "parents")
        if parent.isEmpty():
            break
        above = parent.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        jumped = cut(parent.join(above, F.col("up") == F.col("mid")).select("node", F.col("top").alias("up")), "parents")
        drop_cut(parent)
        at = lambda end: jumped.select(F.col("node").alias(end), F.col("up").alias(f"up_{end}"))  # noqa: E731, B023
        closer = (
            edges.join(at("a"), "a")
            .join(at("b"), "b")
            .filter("up_a <> up_b")
            .select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
            .distinct()
        )
        closer = cut(closer, "links")
        drop_cut(edges)
        edges = closer
        if labels is None:
            labels = jumped
            continue
        new = cut(
            labels.join(jumped.toDF("mid", "top"), F.col("up") == F.col("mid"), "left").select(
                "node", F.coalesce("top", "up").alias("up")
            ),
            "labels",
        )
        drop_cut(labels)
        drop_cut(jumped)
        labels = new
    return (labels if labels is not None else parent).toDF("node", "root")
