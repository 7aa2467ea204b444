"""Set operations between networks, by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshframe.model import Network


def intersection(a: Network, b: Network) -> Network:
    """Nodes in both; edges in both whose ends are nodes in both. Attributes come from a."""
    nodes = a.nodes.join(b.nodes.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_semi")
    edges = a.edges.join(b.edges.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_semi")
    ids = nodes.select(F.col("id").alias("__n"))
    for end in ("src", "dst"):
        edges = edges.join(ids, F.col(end) == F.col("__n"), "left_semi")
    return Network(nodes, edges)


def union(a: Network, b: Network) -> Network:
    """Nodes and edges of either; where both have an id, a's."""
    pick = lambda x, y: x.unionByName(y.join(x.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti"))
    return Network(pick(a.nodes, b.nodes), pick(a.edges, b.edges))
