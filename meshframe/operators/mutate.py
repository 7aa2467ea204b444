"""Adding and removing nodes and edges: every call gives a new network; frames that are passed stay as they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.model import Network


@dataclass(frozen=True)
class Change:
    """The network after a change; the nodes and edges that were added or removed; what could not be."""

    network: Network
    nodes: DataFrame | None
    edges: DataFrame | None
    errors: DataFrame


def _first(x: DataFrame) -> DataFrame:
    """First row of each id; with several of the same ord, any of them. Partial results only."""
    cols = [c for c in x.columns if c != "id"]
    return x.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*cols), "ord").alias("__b")).select("id", "__b.*").select(*x.columns)


def _split(x: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of x whose id isn't in have, and those whose is."""
    h = have.select(F.col("id").alias("__id"))
    return x.join(h, F.col("id") == F.col("__id"), "left_anti"), x.join(h, F.col("id") == F.col("__id"), "left_semi")


def _without(x: DataFrame, accepted: DataFrame | None) -> DataFrame:
    return x if accepted is None else _split(x, accepted)[0]


def _errors(x: DataFrame, kind: str, message: str) -> DataFrame:
    return x.select(F.lit(kind).alias("kind"), F.col("id").alias("entity_id"), F.lit(message).alias("message"))


def add_edge(net: Network, edges: DataFrame, added: DataFrame | None = None, validate: bool = False) -> Change:
    """Insert edges whose id is new, the first of each id. An id that the network has is an error unless it is in `added`.

    Ends need not be nodes unless `validate`; then an edge without both of them is an error.
    """
    edges = edges.where("id is not null")
    new, known = _split(edges, net.edges)
    errors = _errors(_without(known, added), "edge", "Edge already exists")
    if validate:
        ids = net.nodes.select(F.col("id").alias("__n"))
        ok = new.join(ids, F.col("src") == F.col("__n"), "left_semi").join(ids, F.col("dst") == F.col("__n"), "left_semi")
        errors = errors.unionByName(_errors(_split(new, ok)[0], "edge", "An end of the edge does not exist"))
        new = ok
    new = _first(new)
    return Change(Network(net.nodes, net.edges.unionByName(new)), None, new, errors)


def add_node(net: Network, nodes: DataFrame, edges: DataFrame | None = None, added_nodes: DataFrame | None = None, added_edges: DataFrame | None = None) -> Change:
    """Insert nodes whose id is new, then those of `edges` that touch them. Errors hold those of the edges as well."""
    new, known = _split(nodes.where("id is not null"), net.nodes)
    new = _first(new)
    errors = _errors(_without(known, added_nodes), "node", "Node already exists")
    grown = Network(net.nodes.unionByName(new), net.edges)
    if edges is None:
        return Change(grown, new, None, errors)
    ids = new.select(F.col("id").alias("__n"))
    touched = edges.join(ids, F.col("src") == F.col("__n"), "left_semi").unionByName(edges.join(ids, F.col("src") == F.col("__n"), "left_anti").join(ids, F.col("dst") == F.col("__n"), "left_semi"))
    more = add_edge(grown, touched, added_edges)
    return Change(more.network, new, more.edges, errors.unionByName(more.errors))


def remove_edge(net: Network, ids: DataFrame, removed: DataFrame | None = None) -> Change:
    """Delete edges by id (a column `id`); unknown ids are errors unless they are in `removed`. Parallel edges stay."""
    wanted = ids.select("id").where("id is not null").distinct()
    left, gone = _split(net.edges, wanted)
    unknown = _without(_split(wanted, net.edges)[0], removed)
    return Change(Network(net.nodes, left), None, gone, _errors(unknown, "edge", "Edge does not exist"))


def remove_node(net: Network, ids: DataFrame, removed: DataFrame | None = None) -> Change:
    """Delete nodes by id and all edges at them, which come out with `dir`: out (also of a self loop) or in of the node."""
    wanted = ids.select("id").where("id is not null").distinct()
    left, gone = _split(net.nodes, wanted)
    unknown = _without(_split(wanted, net.nodes)[0], removed)
    g = gone.select(F.col("id").alias("__n")).distinct()
    at: Column = F.col("__n")
    out = net.edges.join(g, F.col("src") == at, "left_semi").withColumn("dir", F.lit("out"))
    rest = net.edges.join(g, F.col("src") == at, "left_anti")
    into = rest.join(g, F.col("dst") == at, "left_semi").withColumn("dir", F.lit("in"))
    kept = rest.join(g, F.col("dst") == at, "left_anti")
    return Change(Network(left, kept), gone, out.unionByName(into), _errors(unknown, "node", "Node does not exist"))
