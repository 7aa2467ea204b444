"""Copies. Frames are immutable, so a copy shares them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.model import Network
from meshframe.runtime import cut


def clone_node(net: Network, node: str, new_id: str | None = None) -> DataFrame:
    """The node's row, under new_id if there is one."""
    x = net.nodes.where(F.col("id") == node)
    return x if new_id is None else x.withColumn("id", F.lit(new_id))


def clone_edge(net: Network, edge: str, new_id: str | None = None) -> DataFrame:
    """The edge's row, under new_id if there is one."""
    x = net.edges.where(F.col("id") == edge)
    return x if new_id is None else x.withColumn("id", F.lit(new_id))


def clone_network(net: Network, written: bool = False) -> Network:
    """The same network; `written` also cuts its lineage with written tables."""
    return Network(cut(net.nodes), cut(net.edges)) if written else Network(net.nodes, net.edges)
