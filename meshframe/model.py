"""The graph as two DataFrames, its enumerations, and the schemas that operators share.

nodes: id string, value array<double>, value_is_scalar boolean, meta <any>, ord <orderable>
edges: id string, src string, dst string, atob / btoa array<double>, *_is_scalar boolean, meta <any>, ord <orderable>

"No value" is the empty array. `ord` is the position of an entity: any orderable type, larger is later; every "last wins"
rule is defined over it. Ids are strings; number ids that meet string ids are told apart by a tag (see build.py).
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValueMode(IntEnum):
    """How values of one entity found in several rows are combined."""

    NONE = 0
    OVERRIDE = 1
    CONCAT = 2


class ErrorType(IntEnum):
    BAD_ID = 0
    NODE_NOT_FOUND = 1
    DUPLICATE_NODE_ID = 2
    DUPLICATE_EDGE_ID = 3
    UNKNOWN = 4


class LayerPriority(IntEnum):
    """How a spread deals with nodes that earlier spreads have visited."""

    BLENDS = 0
    OVERRIDES = 1
    TERMINATES = 2
    COMPLETELY_TERMINATES = 3
    TERMINATES_OTHERS = 4





@dataclass(frozen=True)
class Network:
    nodes: DataFrame
    edges: DataFrame

    def adjacency(self) -> DataFrame:
        """(node, nbr, edge_id, dir): each edge from both of its ends, undirected; a self loop comes twice."""
        e = self.edges
        ends: list[Column] = [
            F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.col("id").alias("edge_id"), F.lit("in").alias("dir")),
            F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.col("id").alias("edge_id"), F.lit("out").alias("dir")),
        ]
        return e.select(F.inline(F.array(*ends)))

    def atob(self) -> DataFrame:
        """(src, dst, edge_id): the last edge of each directed pair, found without collecting parallel edges."""
        return self.edges.groupBy("src", "dst").agg(F.max_by("id", F.struct("ord", "id")).alias("edge_id"))

    def persist(self) -> Network:
        return Network(self.nodes.persist(), self.edges.persist())

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()
