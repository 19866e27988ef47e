"""Connected components of links by hooking roots and contracting the links, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import Scratch


def _moved(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``rows`` with every node of ``column`` replaced by its parent, nodes without one as they are."""
    to = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    return rows.join(to, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent")


def _flat(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """A written table of parents, each replaced by its own until it is a root; a path of n steps takes about log2(n) rounds."""
    kept = parents
    while True:
        further = scratch.keep(_moved(parents.select("node", "parent", F.col("parent").alias("old")), "parent", parents))
        moving = further.where("parent <> old").limit(1).count()
        scratch.drop(kept)
        kept, parents = further, further.select("node", "parent")
        if not moving:
            return kept


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v): root is the smallest node reachable.

    Each round every root with a smaller neighbour is hooked to the smallest one, the trees are flattened, and the links are replaced
    by links of roots. Of a root and a neighbour that both have links, one at least is hooked, so each round leaves half of the
    roots at most, whatever order the nodes of a chain have, and links within a tree are gone. Links and labels are written tables:
    joins read plain exchanges, so adaptive execution splits the partition of a hub. Nulls are no nodes; repeated
    links and loops do no harm; no links, no rows.
    """
    given = links.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    edges = scratch.keep(given.select("u", "v").unionByName(given.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = scratch.keep(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    while True:
        hooked = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")).where("parent < node")
        parents = scratch.keep(hooked)
        if not parents.limit(1).count():
            scratch.drop(edges, parents)
            return labels.select("node", "root")
        parents = _flat(parents, scratch)
        moved = scratch.keep(_moved(labels, "root", parents))
        apart = scratch.keep(_moved(_moved(edges, "u", parents), "v", parents).where("u <> v").distinct())
        scratch.drop(labels, edges)
        labels, edges = moved, apart
