"""Consolidating pairwise matches into groups: deterministic Boruvka hooking.

Each round, every component selects its smallest outgoing edge (edges are ordered by their two ends), which hooks it to
the component at the other end. Since the order is total, the only cycles are two components that chose the same edge;
the smaller one becomes the root. The trees collapse by pointer doubling, edges are relabelled by the roots and
deduplicated, and the next round has at most half as many components. All steps are joins and aggregations of checkpointed
tables: rounds grow with the logarithm of the number of ids, and the tables shrink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.runtime import cut, drop, lookup

#: Pointer doublings per written table: each squares the reach, 2 of them follow chains of 4.
JUMPS = 2


def _hook(edges: DataFrame) -> DataFrame:
    """(c, p): every component with an edge and the one it hooks to; a root has p = c."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("c"), "u", "v"), F.struct(F.col("v").alias("c"), "u", "v"))))
    # min_by over a struct, combined before the shuffle: a component with very many edges sends a few rows
    best = ends.groupBy("c").agg(F.min(F.struct("u", "v")).alias("e"))
    return best.select("c", F.when(F.col("e.u") == F.col("c"), F.col("e.v")).otherwise(F.col("e.u")).alias("p"), F.col("e.u").alias("u"), F.col("e.v").alias("v"))


def _root_cycles(hooks: DataFrame) -> DataFrame:
    """Two components that chose the same edge hook to each other: the smaller one becomes the root."""
    twice = hooks.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("u", "v")))
    return twice.select("c", F.when((F.col("n") == 2) & (F.col("c") == F.col("u")), F.col("c")).otherwise(F.col("p")).alias("p"))


def _collapse(tree: DataFrame) -> DataFrame:
    """Pointer doubling until every component points at its root."""
    tree = cut(tree)
    rows = tree.n_rows
    while True:
        out = tree
        for k in range(JUMPS):
            out = lookup(out.select("c", F.col("p").alias(f"p{k}")), f"p{k}", out, "c", "p", "p", rows).select("c", f"p{k}", "p")
            moved = F.col(f"p{k}") != F.col("p")
            out = out.select("c", "p", moved.alias("moved")) if k == JUMPS - 1 else out.select("c", "p")
        before, tree = tree, cut(out, F.col("moved"))
        drop(before)
        if not tree.n_flagged:
            return tree


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node_id, group_id) for every id in `a` or `b`; group_id is the smallest id linked to it directly or indirectly.

    A row with a null end links nothing, its other end still gets a row; self-directed, repeated and turned rows count
    once. Weights and other columns are ignored. Empty pairs give no rows.
    """
    x = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = x.select(F.explode(F.array("a", "b")).alias("node_id")).where("node_id is not null").distinct()
    edges = cut(x.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    maps: list[DataFrame] = []
    while rows := edges.n_rows:
        tree = _collapse(_root_cycles(_hook(edges)))
        maps.append(tree)
        at_u = lookup(edges, "u", tree, "c", "p", "ru", rows)
        both = lookup(at_u, "v", tree, "c", "p", "rv", rows)
        before, edges = edges, cut(both.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        drop(before)
    if not maps:
        return nodes.select("node_id", F.col("node_id").alias("group_id"))
    final = maps[-1]
    for earlier in reversed(maps[:-1]):  # the maps shrink by half or more a round, so all of this costs about one join of the first
        final = lookup(earlier, "p", final, "c", "p", "r", earlier.n_rows, "left").select("c", F.coalesce("r", "p").alias("p"))
    smallest = final.groupBy("p").agg(F.min("c").alias("group_id"))
    named = cut(final) if len(maps) > 1 else final
    named = lookup(named, "p", smallest, "p", "group_id", "group_id", named.n_rows)
    return nodes.join(named.select("c", "group_id"), F.col("node_id") == F.col("c"), "left").select("node_id", F.coalesce("group_id", "node_id").alias("group_id"))
