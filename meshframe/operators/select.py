"""Neighbors, spreading and shared connections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.model import LayerPriority, Network
from meshframe.operators.index import dense_index
from meshframe.runtime import BROADCAST_ROWS, cut, drop


def neighbors(net: Network, nodes: DataFrame, exclude: DataFrame | None = None, include_edge_to_excluded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, nbr) and (node, nbr, edge_id, dir) of nodes (a column `node`), whatever the direction of edges.

    One row an edge: parallel edges repeat a neighbor, a self loop gives its node twice. Nodes in `exclude` (a column `node`)
    are left out, their edges as well unless include_edge_to_excluded.
    """
    wanted = nodes.select(F.col("node").alias("__w")).where("__w is not null").distinct()
    found = net.adjacency().join(wanted, F.col("node") == F.col("__w"), "left_semi")
    if exclude is None:
        return found.select("node", "nbr"), found
    x = exclude.select(F.col("node").alias("__x")).distinct()
    kept = found.join(x, F.col("nbr") == F.col("__x"), "left_anti")
    return kept.select("node", "nbr"), found if include_edge_to_excluded else kept


@dataclass(frozen=True)
class Layer:
    """One execution layer: nodes (source, node), edges (source, edge_id, src_node, dst_node), path (source, node, parent, edge_id).

    Of a spread with mark_parts, all three have a column `chunk` as well: 0 to n_parts - 1, the part of each row; a part may have none.
    """

    depth: int
    nodes: DataFrame
    edges: DataFrame | None
    path: DataFrame | None
    n_parts: int = 1


@dataclass
class SpreadState:
    """What a spread has visited: nodes (source, node, depth) and edges (source, edge_id, depth); None when it was stopped."""

    visited_nodes: DataFrame | None = None
    visited_edges: DataFrame | None = None
    #: Numbers of the earlier spreads that this one has cancelled, and (node) where they may not spread any more.
    cancelled: set[int] = field(default_factory=set)
    overridden: DataFrame | None = None
    #: What other spreads have done to this one: ended it, or taken nodes (node) over that it may not expand any more.
    ended: bool = False
    taken: DataFrame | None = None
    #: Tables written on the way, which layers and visited frames read.
    tables: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Delete the tables of the spread; its layers and frames can't be read afterwards."""
        drop(*self.tables)
        self.tables, self.visited_nodes, self.visited_edges = [], None, None

    def cut(self, df: DataFrame, flag: Column | None = None, also: Column | None = None) -> DataFrame:
        self.tables.append(cut(df, flag, also))
        return self.tables[-1]


def _union(x: DataFrame | None, y: DataFrame) -> DataFrame:
    return y if x is None else x.unionByName(y)


def spread_layers(
    net: Network,
    start: DataFrame,
    *,
    by_source: bool = False,
    exclude_same_depth_edges: bool = False,
    keep_path: bool = False,
    max_depth: int | None = None,
    max_nodes_per_execution: int | None = None,
    mark_parts: bool = False,
    layers: list[SpreadState] | None = None,
    priority: LayerPriority = LayerPriority.BLENDS,
    toward: Callable[[DataFrame], Column] | None = None,
    state: SpreadState | None = None,
    adjacency: DataFrame | None = None,
) -> Iterator[Layer]:
    """Layers of a breadth-first spread from `start` (a column `node`), one at a time: the caller sets the pace.

    Layer 0 holds the start nodes that are members. Each edge comes once, at the layer where the first of its ends is
    expanded. A last layer without nodes still comes if edges are left for it, and ends the spread; max_depth cuts before
    it. by_source spreads from every start node on its own. The parent of a node is the smallest (parent, edge) that
    reaches it. max_nodes_per_execution cuts a layer into parts by node id that share their depth; each is a Layer, or with
    mark_parts the layer stays one Layer whose rows name their part, so that one job can serve any number of parts.
    `toward` keeps candidates (source, node, parent, edge_id) for which its Column is true.

    layers and priority: BLENDS ignores earlier spreads; OVERRIDES takes over the nodes of theirs that it reaches, where they
    may not go on (state.overridden, and `taken` of their states); TERMINATES takes no node of theirs; COMPLETELY_TERMINATES
    ends with the layer that meets one; TERMINATES_OTHERS ends the spreads that it meets (their numbers in `layers` are in
    state.cancelled). Every round looks at what the others have visited by then, so they may run in lock step; a spread
    that has been ended, or whose nodes were taken, heeds it from its next round on.

    A round is a join of the distinct frontier with the adjacency and one with what is visited; its result is written, so
    rounds don't grow the plan. A frontier counted to be small is broadcast, so that the adjacency isn't shuffled; beyond
    that, hubs are split by adaptive execution (spark.sql.adaptive.skewJoin). Layers and visited frames read the tables of
    the rounds, which stay until state.release().
    """
    state = state if state is not None else SpreadState()
    adj = adjacency if adjacency is not None else state.cut(net.adjacency())
    first = start.select("node").where("node is not null").distinct()
    first = first.join(net.nodes.select(F.col("id").alias("__id")), F.col("node") == F.col("__id"), "left_semi")
    source = F.col("node") if by_source else F.lit("*")
    frontier = state.cut(first.select(source.alias("source"), "node"))
    part = [] if max_nodes_per_execution is None else ["chunk"]
    layered = bool(layers) and priority != LayerPriority.BLENDS
    visited = frontier.withColumn("depth", F.lit(0))
    edges_seen: DataFrame | None = None
    state.visited_nodes, state.visited_edges = visited, edges_seen
    if not frontier.n_rows:
        return
    yield Layer(0, frontier.withColumn("chunk", F.lit(0)) if part and mark_parts else frontier, None, None)
    depth, n_frontier, n_parts = 0, frontier.n_rows, 1
    if part:
        frontier, n_parts = _chunked(state, frontier, n_frontier, max_nodes_per_execution, by_source)
    while (max_depth is None or depth < max_depth) and not state.ended:
        owners = {k: x.visited_nodes.select("node").distinct() for k, x in enumerate(layers) if x.visited_nodes is not None} if layered else {}
        others = None
        for o in owners.values():
            others = _union(others, o)
        f = frontier.select(F.col("source").alias("__s"), F.col("node").alias("__n"), *part)
        if state.taken is not None:
            f = f.join(state.taken.select(F.col("node").alias("__o")), F.col("__n") == F.col("__o"), "left_anti")
        f = F.broadcast(f) if n_frontier <= BROADCAST_ROWS else f
        reach = adj.join(f, F.col("__n") == F.col("node")).select(F.col("__s").alias("source"), "node", "nbr", "edge_id", "dir", *part)
        seen = visited.select(F.col("source").alias("__s"), F.col("node").alias("__n"), F.col("depth").alias("nbr_depth"))
        reach = reach.join(seen, (F.col("source") == F.col("__s")) & (F.col("nbr") == F.col("__n")), "left").drop("__s", "__n")
        reach = reach.where(F.col("nbr_depth").isNull() | (F.col("nbr_depth") == depth))
        if toward is not None:
            candidate = reach.select("source", F.col("nbr").alias("node"), F.col("node").alias("parent"), "edge_id", "dir", *part, "nbr_depth")
            candidate = candidate.where(F.col("nbr_depth").isNotNull() | toward(candidate))
            reach = candidate.select("source", F.col("parent").alias("node"), F.col("node").alias("nbr"), "edge_id", "dir", *part, "nbr_depth")
        if others is not None and priority == LayerPriority.TERMINATES:
            reach = reach.join(others.select(F.col("node").alias("__o")), F.col("nbr") == F.col("__o"), "left_anti")
        reach = state.cut(reach, F.col("nbr_depth").isNull())
        new = reach.where("nbr_depth is null").groupBy("source", "nbr").agg(F.min(F.struct("node", "edge_id", *part)).alias("from"))
        new = new.select("source", F.col("nbr").alias("node"), F.col("from.node").alias("parent"), F.col("from.edge_id").alias("edge_id"), *[F.col(f"from.{c}").alias(c) for c in part])
        n_frontier = reach.n_flagged  # at least as many rows as new nodes
        if n_frontier > BROADCAST_ROWS:  # smaller ones are found again where they are read
            new = state.cut(new)
            n_frontier = new.n_rows
        out = reach if not exclude_same_depth_edges else reach.where("nbr_depth is null")
        forward = F.col("dir") == "out"
        ends = F.struct(F.when(forward, F.col("node")).otherwise(F.col("nbr")).alias("a"), F.when(forward, F.col("nbr")).otherwise(F.col("node")).alias("b"))
        by = [F.min(c).alias(c) for c in part]  # chunks are in the order of ids, so this is the chunk of the smaller end
        edges = out.groupBy("source", "edge_id").agg(F.min(ends).alias("e"), *by).select("source", "edge_id", F.col("e.a").alias("src_node"), F.col("e.b").alias("dst_node"), *part)
        depth += 1
        empty = not n_frontier
        if empty and not reach.n_rows:
            return
        n_before = 1 if empty else n_parts
        if part and empty:  # a layer without nodes is one part
            edges = edges.withColumn("chunk", F.lit(0))
        elif part:
            new, n_parts = _chunked(state, new, n_frontier, max_nodes_per_execution, by_source)
            n_frontier = new.n_rows
        nodes = new.select("source", "node")
        visited = visited.unionByName(nodes.withColumn("depth", F.lit(depth)))
        edges_seen = _union(edges_seen, edges.select("source", "edge_id").withColumn("depth", F.lit(depth)))
        if depth % 4 == 0:
            visited, edges_seen = state.cut(visited), state.cut(edges_seen)
        state.visited_nodes, state.visited_edges = visited, edges_seen
        met = False
        if others is not None:
            mine = visited.where("depth > 0").select("node")  # all, as the others may have come later to what was visited before
            if priority == LayerPriority.COMPLETELY_TERMINATES:
                met = not mine.join(others, "node", "left_semi").isEmpty()
            elif priority == LayerPriority.TERMINATES_OTHERS:
                for k in owners.keys() - state.cancelled:
                    if not mine.join(owners[k], "node", "left_semi").isEmpty():
                        state.cancelled.add(k)
                        layers[k].ended = True
            elif priority == LayerPriority.OVERRIDES:
                for k, o in owners.items():
                    hit = state.cut(mine.join(o, "node", "left_semi").distinct())
                    if hit.n_rows:
                        layers[k].taken = state.cut(_union(layers[k].taken, hit).distinct())
                        state.overridden = state.cut(_union(state.overridden, hit).distinct())
        path = new.select("source", "node", "parent", "edge_id", *part) if keep_path else None
        whole = Layer(depth, new.select("source", "node", *part), edges, path, n_before)
        if not part or mark_parts:
            yield whole
        else:
            yield from _parts(state, whole)
        if empty or met:
            return
        frontier = nodes if not part else new.select("source", "node", F.col("own").alias("chunk"))


def _chunked(state: SpreadState, new: DataFrame, rows: int, size: int, by_source: bool) -> tuple[DataFrame, int]:
    """new (written) with the chunk of `size` nodes by id that each node is expanded in, and how many chunks there are.

    Its column is `own` beside a `chunk` in which the node was reached, else `chunk`.
    """
    if rows <= BROADCAST_ROWS:  # few enough for one task
        ranked = new.withColumn("__rank", F.dense_rank().over(Window.orderBy("node")) - 1)
    elif by_source:
        ids = dense_index(new.select("node").distinct(), ["node"], "__rank", state.cut).select(F.col("node").alias("__id"), "__rank")
        ranked = new.join(ids, F.col("node") == F.col("__id")).drop("__id")
    else:
        ranked = dense_index(new, ["node"], "__rank", state.cut)
    name = "own" if "chunk" in new.columns else "chunk"
    out = state.cut(ranked.withColumn(name, F.floor(F.col("__rank") / size)).drop("__rank"), also=F.max(name))
    return out, out.also + 1


def _parts(state: SpreadState, whole: Layer) -> Iterator[Layer]:
    """A Layer for each part of a marked one."""
    nodes = whole.nodes if whole.path is None else whole.path
    edges = state.cut(whole.edges) if whole.n_parts > 1 else whole.edges
    for k in range(whole.n_parts):
        here = nodes.where(F.col("chunk") == k).drop("chunk")
        yield Layer(whole.depth, here.select("source", "node"), edges.where(F.col("chunk") == k).drop("chunk"), here if whole.path is not None else None)


def spread(net: Network, start: DataFrame, results: Callable[[Layer], object] | None = None, **options) -> SpreadState:
    """Spread to the end. `results` gets every layer; what it returns with a true `stop` (key or attribute) ends the spread and clears the state."""
    state = options.pop("state", None) or SpreadState()
    for layer in spread_layers(net, start, state=state, **options):
        answer = results(layer) if results else None
        if answer and (answer.get("stop") if isinstance(answer, dict) else getattr(answer, "stop", False)):
            state.release()
            break
    return state


def in_lock_step(*spreads: Iterator[Layer]) -> Iterator[tuple[int, Layer]]:
    """Layers of several spreads round by round: each waits for the others' cycle. Gives (number of the spread, layer)."""
    live = dict(enumerate(spreads))
    while live:
        for k, s in list(live.items()):
            if (layer := next(s, None)) is None:
                del live[k]
            else:
                yield k, layer


def overlap(state: SpreadState) -> DataFrame:
    """(node, n_sources) of nodes that a spread by source has reached from more than one of them."""
    x = state.visited_nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n_sources"))  # (source, node) is unique
    return x.where("n_sources > 1")


def shared_connection(net: Network, nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node) within `depth` of every one of `nodes` (a column `node`), themselves left out, and edges among both."""
    wanted = cut(nodes.select("node").where("node is not null").distinct())
    n = wanted.n_rows
    state = spread(net, wanted, by_source=True, max_depth=depth)
    near = state.visited_nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("node")
    shared = near.join(wanted.select(F.col("node").alias("__w")), F.col("node") == F.col("__w"), "left_anti")
    ends = shared.unionByName(wanted).select(F.col("node").alias("__n"))
    edges = net.edges.join(ends, F.col("src") == F.col("__n"), "left_semi").join(ends, F.col("dst") == F.col("__n"), "left_semi")
    return shared, edges
