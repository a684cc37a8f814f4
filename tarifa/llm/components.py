"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import materialize


def _jump(labels: DataFrame) -> DataFrame:
    """Each node's label replaced by its label's label; ``open`` where that is another one."""
    after = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return labels.join(after, "label", "left").select("node", F.coalesce("next", "label").alias("label"), (F.col("next") != F.col("label")).alias("open"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    Each round hooks a node to its smallest neighbour (or itself) and follows these pointers by jumps, each twice as far as
    the one before, until they lead to nodes that point to themselves; then both ends of every link are replaced by these,
    and links within a label dropped. Of any linked nodes at most half are smaller than all their neighbours, so both rounds
    and jumps grow with the logarithm of the number of nodes; a chain in the order of the nodes takes one round. Names of
    nodes are moved on in each round, so plans stay small.

    All is joins and aggregations with partial sums: a node with very many links is pre-aggregated before the shuffle,
    and the joins may be split by AQE. Links with a null end are left out.
    """
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).isNotNull().alias("ok"), F.col(b).isNotNull().alias("ok2"))
    links = materialize(links.where("ok AND ok2 AND a < b").select("a", "b").distinct(), "links")
    names: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "hooks")
        while True:  # two jumps at a time; a label that the second one leaves as it is points to itself
            labels = materialize(_jump(_jump(labels)), "labels")
            if labels.where("open").isEmpty():
                break
        labels = labels.select("node", "label")
        moved = links.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la <> lb")
        links = materialize(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        # a node that is no longer in any link has its final label
        names = labels if names is None else materialize(names.join(labels.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label")), "names")
    if names is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names.select("node", F.col("label").alias("component"))
