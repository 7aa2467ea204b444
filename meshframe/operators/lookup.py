"""Single and batched lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.model import Network


def get_node_by_id(net: Network, node: str) -> DataFrame:
    """The node's row, or none."""
    return net.nodes.where(F.col("id") == node)


def get_edge_by_id(net: Network, edge: str) -> DataFrame:
    """The edge's row, or none."""
    return net.edges.where(F.col("id") == edge)


def get_edge(net: Network, a: str, b: str) -> DataFrame:
    """The last added edge from a to b as one row, or none. Direction matters.

    The filter reaches the scan of a stored network (sources.graphs.read_network); in one that is still to be built, the
    last row of each id must be found before its ends are known.
    """
    return net.edges.where((F.col("src") == a) & (F.col("dst") == b)).orderBy(F.desc("ord"), F.desc("id")).limit(1)


def get_edges(net: Network, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with edge_id: the last edge from a to b, null if there is none; repeated pairs stay."""
    x = net.atob()
    return pairs.join(x, (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")), "left").drop("src", "dst")


def has_node(net: Network, ids: list[str]) -> bool:
    """True if all ids are nodes; true for no ids. At most len(ids) rows are looked for."""
    wanted = sorted(set(ids))
    return not wanted or net.nodes.where(F.col("id").isin(wanted)).select("id").distinct().count() == len(wanted)


def has_nodes(net: Network, ids: DataFrame) -> DataFrame:
    """ids (id) with is_member; a null id is no member."""
    n = net.nodes.select(F.col("id").alias("__id")).distinct()
    return ids.join(n, F.col("id") == F.col("__id"), "left").withColumn("is_member", F.col("__id").isNotNull()).drop("__id")
