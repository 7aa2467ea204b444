"""Shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.model import Network
from meshframe.operators.lookup import has_node
from meshframe.operators.select import SpreadState, spread_layers
from meshframe.runtime import BROADCAST_ROWS, cut, drop

SCHEMA = "step int, node string, distance double"


def _back(spark, steps: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame([(k, n, float(d)) for k, (n, d) in enumerate(steps)], SCHEMA)


def path(net: Network, a: str, b: str, weighted: bool = False, directed: bool = False) -> DataFrame:
    """(step, node, distance from a) along a shortest path from a to b; [a] with 0 for a itself.

    No rows if either is no node or b can't be reached. Distances are hops, or with `weighted` sums of atob[0] (a to b) and
    btoa[0] (b to a), where an edge without the weight can't be walked and a negative weight is an error. Ties go to the
    smallest (parent, edge). Only what the path holds comes to the driver, one row and one small job a step. The tables of
    the search are deleted.
    """
    spark = net.nodes.sparkSession
    if not has_node(net, [a, b]):
        return spark.createDataFrame([], SCHEMA)
    if a == b:
        return _back(spark, [(a, 0.0)])
    return _weighted(net, a, b, directed) if weighted else _hops(net, a, b, directed)


def _hops(net: Network, a: str, b: str, directed: bool) -> DataFrame:
    spark = net.nodes.sparkSession
    state = SpreadState()
    adj = net.adjacency()
    adj = state.cut(adj.where("dir = 'out'") if directed else adj)
    found: list[DataFrame] = []
    for layer in spread_layers(net, spark.createDataFrame([(a,)], "node string"), keep_path=True, adjacency=adj, state=state):
        if layer.depth == 0:
            continue
        found.append(layer.path)
        if last := layer.path.where(F.col("node") == b).select("parent").first():
            break
    else:
        state.release()
        return spark.createDataFrame([], SCHEMA)
    steps = [b, last["parent"]]
    for parents in reversed(found[:-1]):
        steps.append(parents.where(F.col("node") == steps[-1]).first()["parent"])
    state.release()
    return _back(spark, [(n, k) for k, n in enumerate(reversed(steps))])


#: Rounds of improvements that are kept as tables of their own.
KEPT = 6


def _weighted(net: Network, a: str, b: str, directed: bool) -> DataFrame:
    """Relaxation round by round: only nodes whose distance fell in the last round send offers; nothing beyond b's is kept.

    A round writes the rows that it improves; the best row of a node is its smallest (distance, parent, edge) over the
    rounds, which are merged into one table every KEPT rounds. The distance of b so far is observed as a round is written.
    """
    spark = net.nodes.sparkSession
    e = net.edges
    walk = e.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.col("id").alias("edge_id"), F.get("atob", F.lit(0)).alias("w"), F.get("btoa", F.lit(0)).alias("back"))
    if not directed:
        ways = [F.struct("node", "nbr", "edge_id", "w"), F.struct(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "edge_id", F.col("back").alias("w"))]
        walk = walk.select(F.inline(F.array(*ways)))
    walk = walk.where(F.col("w").isNotNull() & ~F.isnan("w"))
    walk = cut(walk.groupBy("node", "nbr").agg(F.min(F.struct("w", "edge_id")).alias("b")).select("node", "nbr", "b.*"), F.col("w") < 0)
    tables = [walk]
    if walk.n_flagged:
        drop(walk)
        raise ValueError("negative weight")
    key = lambda parent, edge: F.struct("d", F.coalesce(parent, F.lit("")).alias("parent"), F.coalesce(edge, F.lit("")).alias("edge_id"))
    rounds = [spark.createDataFrame([(a, (0.0, "", ""))], "node string, k struct<d: double, parent: string, edge_id: string>")]
    changed, n_changed, limit = rounds[0], 1, None
    while n_changed:
        best = reduce(DataFrame.unionByName, [x.select("node", "k") for x in rounds])
        if len(rounds) > KEPT:
            best = cut(best.groupBy("node").agg(F.min("k").alias("k")))
            tables.append(best)
            rounds = [best]
        f = changed.select(F.col("node").alias("parent"), F.col("k.d").alias("pd"))
        offers = walk.join(F.broadcast(f) if n_changed <= BROADCAST_ROWS else f, F.col("parent") == F.col("node"))
        offers = offers.select(F.col("nbr").alias("node"), (F.col("pd") + F.col("w")).alias("d"), "parent", "edge_id")
        if limit is not None:
            offers = offers.where(F.col("d") <= limit)
        offers = offers.select("node", key(F.col("parent"), F.col("edge_id")).alias("k"), F.lit(None).cast(best.schema["k"].dataType).alias("old"))
        both = offers.unionByName(best.select("node", F.lit(None).cast(best.schema["k"].dataType).alias("k"), F.col("k").alias("old")))
        x = both.groupBy("node").agg(F.min("k").alias("k"), F.min("old").alias("old"))
        x = x.where(F.col("k").isNotNull() & (F.col("old").isNull() | (F.col("k") < F.col("old"))))
        x = cut(x.select("node", "k", (F.col("old").isNull() | (F.col("k.d") < F.col("old.d"))).alias("changed")), F.col("changed"), F.min(F.when(F.col("node") == b, F.col("k.d"))))
        tables.append(x)
        rounds.append(x)
        limit = limit if x.also is None else x.also if limit is None else min(limit, x.also)
        changed, n_changed = x.where("changed"), x.n_flagged
    best = reduce(DataFrame.unionByName, [x.select("node", "k") for x in rounds])
    steps, at = [], b
    while at and (k := best.where(F.col("node") == at).agg(F.min("k")).first()[0]):
        steps.append((at, k["d"]))
        at = k["parent"]
    drop(*tables)
    return _back(spark, steps[::-1]) if steps else spark.createDataFrame([], SCHEMA)
