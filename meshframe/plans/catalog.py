"""Queries of the graph operators over graphs made of the supplied tables, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.functions import presence
from meshframe.model import ErrorType, LayerPriority, ValueMode
from meshframe.operators import clone, lookup, mutate, paths, select, setops
from meshframe.operators.build import make_network
from meshframe.runtime import new_path, read
from meshframe.sources import graphs

# ---- building


def mk_nodes_geo(s: SparkSession, d: str) -> DataFrame:
    return graphs.geo(s, d).network.nodes.select("id", F.col("meta.name").alias("name"))


def mk_edges_geo(s: SparkSession, d: str) -> DataFrame:
    return graphs.geo(s, d).network.edges.select("id", "src", "dst")


def mk_dup_edges_last(s: SparkSession, d: str) -> DataFrame:
    net = graphs.line(s, d, edge_values=("l_quantity", "l_tax")).network
    return net.edges.select("id", "src", "dst", F.get("atob", F.lit(0)).alias("ab"), F.get("btoa", F.lit(0)).alias("ba"))


def mk_dup_edge_errors(s: SparkSession, d: str) -> DataFrame:
    return graphs.line(s, d).errors.groupBy("error", "entity_id").agg(F.count(F.lit(1)).alias("n_errors"))


def _by_customer(s: SparkSession, d: str, **more):
    o = read(s, d, "orders")
    none = s.createDataFrame([], "id string, a bigint, b bigint")
    return make_network(o, none, node_id="o_custkey", node_values="o_totalprice", node_order=["o_orderdate", "o_orderkey"], edge_id="id", edge_a="a", edge_b="b", edge_order=["id"], **more)


def mk_dup_node_last(s: SparkSession, d: str) -> DataFrame:
    return _by_customer(s, d).network.nodes.select("id", F.get("value", F.lit(0)).alias("value"))


def mk_dup_node_errors(s: SparkSession, d: str) -> DataFrame:
    return _by_customer(s, d).errors.groupBy("error", "entity_id").agg(F.count(F.lit(1)).alias("n_errors"))


SMALL_PARTS = "p_size <= 25"


def mk_orphan_edges(s: SparkSession, d: str) -> DataFrame:
    return graphs.line(s, d, SMALL_PARTS).network.edges.select("id", "src", "dst")


def mk_orphan_errors(s: SparkSession, d: str) -> DataFrame:
    x = graphs.line(s, d, SMALL_PARTS).errors.where("error = 'NODE_NOT_FOUND'")
    return x.groupBy("error", "entity_id", "message").agg(F.count(F.lit(1)).alias("n_errors"))


def mk_suppressed_errors(s: SparkSession, d: str) -> DataFrame:
    x = graphs.line(s, d, SMALL_PARTS, suppress_errors=[ErrorType.DUPLICATE_EDGE_ID]).errors
    return x.groupBy("error").agg(F.count(F.lit(1)).alias("n_errors"))


def mk_autoid(s: SparkSession, d: str) -> DataFrame:
    """Customers in debt have no id of their own."""
    c = read(s, d, "customer").withColumn("id", F.when(F.col("c_acctbal") >= 0, F.col("c_name")))
    none = s.createDataFrame([], "id string, a string, b string")
    net = make_network(c, none, node_id="id", node_meta=lambda _: F.struct("c_name"), node_order=["c_custkey"], edge_id="id", edge_a="a", edge_b="b", edge_order=["id"]).network
    return net.nodes.select("id", F.col("meta.c_name").alias("name"))


def mk_multi_id(s: SparkSession, d: str) -> DataFrame:
    """One node a tag; the last document with it wins."""
    x = read(s, d, "documents").select("doc_id", "tags")
    none = s.createDataFrame([], "id string, a string, b string")
    net = make_network(x, none, node_id="tags", node_values="doc_id", node_order=["doc_id"], edge_id="id", edge_a="a", edge_b="b", edge_order=["id"]).network
    return net.nodes.select("id", F.get("value", F.lit(0)).alias("last_doc"))


def mk_multi_id_missing(s: SparkSession, d: str) -> DataFrame:
    """The same where tags that begin with a vowel are empty and those with a digit null, and questions have no list: all of these are numbered."""
    bare = F.transform("tags", lambda t: F.when(t.rlike("^[aeiou]"), "").otherwise(F.when(~t.rlike("[0-9]"), t)))
    x = read(s, d, "documents").select("doc_id", F.when(F.col("post_type").isNull() | (F.col("post_type") != "question"), bare).alias("tags"))
    none = s.createDataFrame([], "id string, a string, b string")
    net = make_network(x, none, node_id="tags", node_values="doc_id", node_order=["doc_id"], edge_id="id", edge_a="a", edge_b="b", edge_order=["id"]).network
    return net.nodes.select("id", F.get("value", F.lit(0)).alias("last_doc"))


def mk_edge_guard(s: SparkSession, d: str) -> DataFrame:
    """Edges whose tax is 0 lack the weight back, and so have neither."""
    net = graphs.line(s, d, edge_values=("l_quantity", lambda _: F.when(F.col("l_tax") > 0, F.col("l_tax")))).network
    return net.edges.select("id", F.size("atob").alias("n_ab"), F.size("btoa").alias("n_ba"))


def mk_agg_errors(s: SparkSession, d: str) -> DataFrame:
    """Aggregated line items with two ids each, the second missing of returned ones; large parts are no nodes."""
    twice = F.array("id", F.when(F.col("l_returnflag") != "R", F.col("id")))
    rows = graphs.line_rows(s, d).withColumn("ids", twice)
    made = make_network(graphs.line_nodes(s, d, SMALL_PARTS), rows, node_id="id", edge_id="ids", edge_a="a", edge_b="b", node_order=["id"], edge_order=graphs.LINE_ORDER, aggregate_results=True)
    return made.errors.groupBy("error", "entity_id", "message").agg(F.count(F.lit(1)).alias("n_errors"), F.sum(F.size("source")).alias("n_sources"))


def mk_map_meta(s: SparkSession, d: str) -> DataFrame:
    """Orders of a customer merged, as maps from priority to status: the last status of each priority."""
    meta = lambda _: F.create_map("o_orderpriority", "o_orderstatus")
    nodes = _by_customer(s, d, node_meta=meta, aggregate_results=True).network.nodes
    return nodes.select("id", F.explode("meta").alias("priority", "status"))


def _aggregated(s: SparkSession, d: str, mode: ValueMode) -> DataFrame:
    """Weights of line items by id: a list of quantity and tax (missing where 0), and only the quantity of returned items."""
    tax = F.when(F.col("l_tax") > 0, F.col("l_tax"))
    both = lambda _: F.when(F.col("l_returnflag") == "R", F.array("l_quantity")).otherwise(F.array(F.col("l_quantity"), tax))
    net = graphs.line(s, d, edge_values=(both, both), aggregate_results=True, aggregate_value_mode=mode).network
    return net.edges.select("id", F.posexplode("atob").alias("pos", "w"))


def mk_agg_none(s: SparkSession, d: str) -> DataFrame:
    return _aggregated(s, d, ValueMode.NONE)


def mk_agg_override(s: SparkSession, d: str) -> DataFrame:
    return _aggregated(s, d, ValueMode.OVERRIDE)


def mk_agg_concat(s: SparkSession, d: str) -> DataFrame:
    return _aggregated(s, d, ValueMode.CONCAT)


def mk_agg_meta(s: SparkSession, d: str) -> DataFrame:
    """Orders of a customer merged: last status, and last priority among the finished."""
    meta = lambda _: F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("priority"))
    nodes = _by_customer(s, d, node_meta=meta, aggregate_results=True).network.nodes
    return nodes.select("id", F.col("meta.status").alias("status"), F.col("meta.priority").alias("priority"), F.get("value", F.lit(0)).alias("value"))


def mk_agg_partial_edges(s: SparkSession, d: str) -> DataFrame:
    """Each edge of the supply graph in two rows: one with its supplier, one with its part."""
    e = graphs.supply(s, d).network.edges.select("id", "src", "dst")
    nothing = F.lit(None).cast("string")
    halves = e.select("id", F.lit(0).alias("k"), F.col("src").alias("a"), nothing.alias("b")).unionByName(e.select("id", F.lit(1).alias("k"), nothing.alias("a"), F.col("dst").alias("b")))
    net = make_network(graphs.supply(s, d).network.nodes.select("id"), halves, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_order=["id"], edge_order=["id", "k"], aggregate_results=True).network
    return net.edges.select("id", "src", "dst")


# ---- lookups


def lk_get_edge(s: SparkSession, d: str) -> DataFrame:
    return lookup.get_edge(graphs.geo(s, d).network, "r0", "n0").select("id", "src", "dst")


def lk_node(s: SparkSession, d: str) -> DataFrame:
    return lookup.get_node_by_id(graphs.geo(s, d).network, "n3").select("id", F.col("meta.name").alias("name"))


def lk_edge(s: SparkSession, d: str) -> DataFrame:
    return lookup.get_edge_by_id(graphs.geo(s, d).network, "rn3").select("id", "src", "dst")


def lk_get_edges(s: SparkSession, d: str) -> DataFrame:
    """The last event edge back from where each edge leads, and one that doesn't exist."""
    net = graphs.event(s, d).network
    pairs = net.edges.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()
    return lookup.get_edges(net, pairs.unionByName(s.createDataFrame([("click", "nowhere")], "a string, b string"))).select("a", "b", "edge_id")


def lk_has_node(s: SparkSession, d: str) -> DataFrame:
    ids = read(s, d, "nation").select(F.concat(F.lit("n"), (F.col("n_nationkey") + 10).cast("string")).alias("id"))
    return lookup.has_nodes(graphs.geo(s, d).network, ids)


def lk_atob_last(s: SparkSession, d: str) -> DataFrame:
    return graphs.event(s, d).network.atob()


# ---- mutation


def _more_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges from suppliers to their region: new ids, and the ids of the nations' edges again."""
    x = read(s, d, "supplier").join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    new = x.select(graphs.tag("sr", "s_suppkey").alias("id"), graphs.tag("s", "s_suppkey").alias("src"), graphs.tag("r", "n_regionkey").alias("dst"))
    again = read(s, d, "nation").select(graphs.tag("rn", "n_nationkey").alias("id"), graphs.tag("n", "n_nationkey").alias("src"), graphs.tag("r", "n_regionkey").alias("dst"))
    none = F.expr("cast(array() as array<double>)")
    cols = [none.alias("atob"), F.lit(False).alias("atob_is_scalar"), none.alias("btoa"), F.lit(False).alias("btoa_is_scalar"), F.lit(None).cast("string").alias("meta"), F.struct("id").alias("ord")]
    return new.unionByName(again).select("*", *cols)


def mu_add_edge(s: SparkSession, d: str) -> DataFrame:
    return mutate.add_edge(graphs.geo(s, d).network, _more_edges(s, d)).network.edges.select("id", "src", "dst")


def mu_add_edge_errors(s: SparkSession, d: str) -> DataFrame:
    return mutate.add_edge(graphs.geo(s, d).network, _more_edges(s, d)).errors


def mu_added_before(s: SparkSession, d: str) -> DataFrame:
    """Errors of the same call when some of the nations' edges were added by an earlier one."""
    before = graphs.geo(s, d).network.edges.where(F.col("id").isin("rn0", "rn1", "rn2"))
    return mutate.add_edge(graphs.geo(s, d).network, _more_edges(s, d), added=before).errors


def mu_removed_before(s: SparkSession, d: str) -> DataFrame:
    """Errors of removing edges of which some were removed by an earlier call."""
    before = _some_edges(s, d).where(F.length("id") < 5)
    return mutate.remove_edge(graphs.geo(s, d).network, _some_edges(s, d), removed=before).errors


def mu_add_node(s: SparkSession, d: str) -> DataFrame:
    """Segments join the graph with an edge to each of their customers; what then is there."""
    c = read(s, d, "customer")
    none = F.expr("cast(array() as array<double>)")
    nodes = c.select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("id"), none.alias("value"), F.lit(False).alias("value_is_scalar"), F.struct(F.col("c_mktsegment").alias("name")).alias("meta"), F.struct(F.col("c_mktsegment").alias("id")).alias("ord"))
    edges = c.select(graphs.tag("m", "c_custkey").alias("id"), F.col("c_mktsegment").alias("src"), graphs.tag("c", "c_custkey").alias("dst"), none.alias("atob"), F.lit(False).alias("atob_is_scalar"), none.alias("btoa"), F.lit(False).alias("btoa_is_scalar"), F.lit(None).cast("string").alias("meta"), F.struct(graphs.tag("m", "c_custkey").alias("id")).alias("ord"))
    net = mutate.add_node(graphs.geo(s, d).network, nodes, edges).network
    return net.nodes.select(F.lit("node").alias("kind"), "id").unionByName(net.edges.select(F.lit("edge").alias("kind"), "id"))


def _some_edges(s: SparkSession, d: str) -> DataFrame:
    """Ids of supplier edges as of customers: those beyond the suppliers are unknown."""
    return read(s, d, "customer").select(graphs.tag("ns", "c_custkey").alias("id"))


def mu_remove_edge(s: SparkSession, d: str) -> DataFrame:
    return mutate.remove_edge(graphs.geo(s, d).network, _some_edges(s, d)).network.edges.select("id", "src", "dst")


def mu_remove_edge_errors(s: SparkSession, d: str) -> DataFrame:
    return mutate.remove_edge(graphs.geo(s, d).network, _some_edges(s, d)).errors


def _nation_ids(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "nation").where("n_regionkey < 2").select(graphs.tag("n", "n_nationkey").alias("id"))


def mu_remove_node(s: SparkSession, d: str) -> DataFrame:
    net = mutate.remove_node(graphs.geo(s, d).network, _nation_ids(s, d)).network
    return net.nodes.select(F.lit("node").alias("kind"), "id").unionByName(net.edges.select(F.lit("edge").alias("kind"), "id"))


def mu_removed_edges(s: SparkSession, d: str) -> DataFrame:
    return mutate.remove_node(graphs.geo(s, d).network, _nation_ids(s, d)).edges.select("id", "dir")


# ---- clones and set operations


def cl_node(s: SparkSession, d: str) -> DataFrame:
    return clone.clone_node(graphs.geo(s, d).network, "n0", "copy").select("id", F.col("meta.name").alias("name"))


def cl_edge(s: SparkSession, d: str) -> DataFrame:
    return clone.clone_edge(graphs.geo(s, d).network, "rn0", "copy").select("id", "src", "dst")


def cl_network(s: SparkSession, d: str) -> DataFrame:
    return clone.clone_network(graphs.geo(s, d).network, written=True).edges.select("id", "src", "dst")


def _halves(s: SparkSession, d: str):
    """Two parts of the geo graph that share some nations."""
    net = graphs.geo(s, d).network
    part = lambda r: mutate.remove_node(net, read(s, d, "nation").where(r).select(graphs.tag("n", "n_nationkey").alias("id"))).network
    return part("n_nationkey < 8"), part("n_nationkey > 16")


def so_intersect_nodes(s: SparkSession, d: str) -> DataFrame:
    return setops.intersection(*_halves(s, d)).nodes.select("id")


def so_intersect_edges(s: SparkSession, d: str) -> DataFrame:
    return setops.intersection(*_halves(s, d)).edges.select("id", "src", "dst")


def so_union_nodes(s: SparkSession, d: str) -> DataFrame:
    return setops.union(*_halves(s, d)).nodes.select("id")


def so_union_edges(s: SparkSession, d: str) -> DataFrame:
    return setops.union(*_halves(s, d)).edges.select("id", "src", "dst")


# ---- neighbors and spreading


def _ids(s: SparkSession, *ids: str) -> DataFrame:
    return s.createDataFrame([(i,) for i in ids], "node string")


def nb_all(s: SparkSession, d: str) -> DataFrame:
    """Neighbors of every nation, one row an edge."""
    nations = read(s, d, "nation").select(graphs.tag("n", "n_nationkey").alias("node"))
    return select.neighbors(graphs.geo(s, d).network, nations)[1]


def nb_exclude(s: SparkSession, d: str) -> DataFrame:
    seen = read(s, d, "supplier").select(graphs.tag("s", "s_suppkey").alias("node"))
    return select.neighbors(graphs.geo(s, d).network, _ids(s, "n0", "n1"), seen)[0]


def nb_exclude_edges(s: SparkSession, d: str) -> DataFrame:
    seen = read(s, d, "supplier").select(graphs.tag("s", "s_suppkey").alias("node"))
    return select.neighbors(graphs.geo(s, d).network, _ids(s, "n0", "n1"), seen, include_edge_to_excluded=True)[1]


def nb_event_multiplicity(s: SparkSession, d: str) -> DataFrame:
    """How often each event type is a neighbor of each: parallel edges and self loops count."""
    net = graphs.event(s, d).network
    nodes = select.neighbors(net, net.nodes.select(F.col("id").alias("node")))[0]
    return nodes.groupBy("node", "nbr").agg(F.count(F.lit(1)).alias("n"))


def _depths(state: select.SpreadState) -> DataFrame:
    return state.visited_nodes.select("node", "depth")


def sp_depths(s: SparkSession, d: str) -> DataFrame:
    return _depths(select.spread(graphs.geo(s, d).network, _ids(s, "r0")))


def sp_layers(s: SparkSession, d: str) -> DataFrame:
    """Layer sizes over the supply graph from s0, as the callback sees them, with the last layer without nodes if edges are left for it."""
    seen: list[tuple[int, int]] = []
    select.spread(graphs.supply(s, d).network, _ids(s, "s0"), lambda layer: seen.append((layer.depth, layer.nodes.count())))
    return s.createDataFrame(seen, "depth int, n_nodes bigint")


def sp_trade_layers(s: SparkSession, d: str) -> DataFrame:
    """Layer sizes over the trade graph from c0, to the end of the spread."""
    state = select.spread(graphs.trade(s, d).network, _ids(s, "c0"))
    return state.visited_nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"))


def sp_trade_paths(s: SparkSession, d: str) -> DataFrame:
    """Parents over the trade graph from c0, to the end of the spread."""
    return _parents(graphs.trade(s, d).network, _ids(s, "c0"))


def sp_chain_depths(s: SparkSession, d: str) -> DataFrame:
    """Depths along the chain of a customer's orders, from order 0: one or two nodes a layer."""
    return _depths(select.spread(graphs.chain(s, d).network, _ids(s, "0")))


def sp_toward(s: SparkSession, d: str) -> DataFrame:
    """A spread that is led away from customers."""
    return _depths(select.spread(graphs.geo(s, d).network, _ids(s, "s0"), toward=lambda c: ~F.col("node").startswith("c")))


def sp_multi_seed(s: SparkSession, d: str) -> DataFrame:
    return _depths(select.spread(graphs.geo(s, d).network, _ids(s, "n0", "n1", "s2", "none")))


def sp_maxdepth(s: SparkSession, d: str) -> DataFrame:
    return _depths(select.spread(graphs.trade(s, d).network, _ids(s, "c0"), max_depth=2))


def sp_paths(s: SparkSession, d: str) -> DataFrame:
    return _parents(graphs.supply(s, d).network, _ids(s, "s0"))


def _parents(net, start: DataFrame) -> DataFrame:
    found = [layer.path for layer in select.spread_layers(net, start, keep_path=True) if layer.path is not None]
    return reduce(DataFrame.unionByName, found).select("node", "parent", "edge_id")


def sp_edges(s: SparkSession, d: str) -> DataFrame:
    return select.spread(graphs.geo(s, d).network, _ids(s, "s0")).visited_edges.select("edge_id", "depth")


def sp_no_same_depth(s: SparkSession, d: str) -> DataFrame:
    return select.spread(graphs.event(s, d).network, _ids(s, "click"), exclude_same_depth_edges=True).visited_edges.select("edge_id", "depth")


def sp_tree_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges that lead to a node not reached before."""
    state = select.spread(graphs.supply(s, d).network, _ids(s, "s0"), exclude_same_depth_edges=True)
    return state.visited_edges.select("edge_id", "depth")


def sp_overlap(s: SparkSession, d: str) -> DataFrame:
    return select.overlap(select.spread(graphs.supply(s, d).network, _ids(s, "s0", "s1", "s2"), by_source=True))


def sp_stop(s: SparkSession, d: str) -> DataFrame:
    """Stopped at layer 2: layers seen until then; the state is empty afterwards."""
    seen: list[tuple[int, int]] = []

    def results(layer):
        seen.append((layer.depth, layer.nodes.count()))
        return {"stop": layer.depth == 2}

    state = select.spread(graphs.geo(s, d).network, _ids(s, "s0"), results)
    return s.createDataFrame([(*x, state.visited_nodes is None) for x in seen], "depth int, n_nodes bigint, cleared boolean")


def sp_chunked(s: SparkSession, d: str) -> DataFrame:
    """Parts of at most 20 nodes expanded at once: sizes of the parts' results."""
    sizes, n = [], 0
    for x in select.spread_layers(graphs.supply(s, d).network, _ids(s, "s0"), max_nodes_per_execution=20, mark_parts=True):
        row = lambda part, one: [part.cast("int").alias("part"), F.lit(x.depth).alias("depth"), F.lit(one).cast("bigint").alias("n_nodes")]  # noqa: B023, E731
        sizes += [s.range(n, n + x.n_parts, 1, 1).select(*row(F.col("id"), 0)), x.nodes.select(*row(F.col("chunk") + n, 1))]
        n += x.n_parts
    if not sizes:  # no such node
        return s.createDataFrame([], "part int, depth int, n_nodes bigint")
    return reduce(DataFrame.unionByName, sizes).groupBy("part", "depth").agg(F.sum("n_nodes").alias("n_nodes"))


def _layered(s: SparkSession, d: str, priority: LayerPriority):
    net = graphs.supply(s, d).network
    first = select.spread(net, _ids(s, "s1"), max_depth=2)
    return first, select.spread(net, _ids(s, "s0"), max_depth=4, layers=[first], priority=priority)


def sp_layering_blends(s: SparkSession, d: str) -> DataFrame:
    return _depths(_layered(s, d, LayerPriority.BLENDS)[1])


def sp_layering_overrides(s: SparkSession, d: str) -> DataFrame:
    """Nodes of the first spread that the second takes over."""
    first, second = _layered(s, d, LayerPriority.OVERRIDES)
    return (second.overridden if second.overridden is not None else first.visited_nodes.limit(0)).select("node")


def sp_layering_terminates(s: SparkSession, d: str) -> DataFrame:
    return _depths(_layered(s, d, LayerPriority.TERMINATES)[1])


def sp_layering_completely(s: SparkSession, d: str) -> DataFrame:
    return _depths(_layered(s, d, LayerPriority.COMPLETELY_TERMINATES)[1])


def sp_layering_others(s: SparkSession, d: str) -> DataFrame:
    """Numbers of the spreads that were cancelled."""
    second = _layered(s, d, LayerPriority.TERMINATES_OTHERS)[1]
    return s.createDataFrame([(k,) for k in sorted(second.cancelled)], "spread int")


def sp_waits(s: SparkSession, d: str) -> DataFrame:
    """Two spreads in lock step: the order in which their layers come."""
    net = graphs.geo(s, d).network
    steps = select.in_lock_step(select.spread_layers(net, _ids(s, "r0")), select.spread_layers(net, _ids(s, "s0")))
    return s.createDataFrame([(i, k, x.depth, x.nodes.count()) for i, (k, x) in enumerate(steps)], "turn int, spread int, depth int, n_nodes bigint")


def _layered_steps(s: SparkSession, d: str, priority: LayerPriority) -> DataFrame:
    """A spread from s1 in lock step with one from s0 that is layered over it, both to their end."""
    net, first = graphs.supply(s, d).network, select.SpreadState()
    steps = select.in_lock_step(select.spread_layers(net, _ids(s, "s1"), state=first), select.spread_layers(net, _ids(s, "s0"), layers=[first], priority=priority))
    return s.createDataFrame([(i, k, x.depth, x.nodes.count()) for i, (k, x) in enumerate(steps)], "turn int, spread int, depth int, n_nodes bigint")


def sp_waits_overrides(s: SparkSession, d: str) -> DataFrame:
    """The second spread takes over nodes that the first, still running, may not expand any more."""
    return _layered_steps(s, d, LayerPriority.OVERRIDES)


def sp_waits_others(s: SparkSession, d: str) -> DataFrame:
    """The second spread ends the first, still running, where it meets it."""
    return _layered_steps(s, d, LayerPriority.TERMINATES_OTHERS)


def sh_connection_nodes(s: SparkSession, d: str) -> DataFrame:
    return select.shared_connection(graphs.trade(s, d).network, _ids(s, "s0", "s1"), 1)[0]


def sh_connection_edges(s: SparkSession, d: str) -> DataFrame:
    return select.shared_connection(graphs.trade(s, d).network, _ids(s, "s0", "s1"), 1)[1].select("id", "src", "dst")


def pa_hops(s: SparkSession, d: str) -> DataFrame:
    return paths.path(graphs.trade(s, d).network, "c0", "c1").select("step", "node", "distance")


def pa_weighted(s: SparkSession, d: str) -> DataFrame:
    """Distance of the cheapest way from s0 to s2 over the supply graph."""
    x = paths.path(graphs.supply(s, d).network, "s0", "s2", weighted=True)
    return x.agg(F.max("distance").alias("distance"))


def pa_weighted_line(s: SparkSession, d: str) -> DataFrame:
    """Distance of the cheapest way from o0 to o1 over all line items, weighted by quantity there and tax in percent back."""
    net = graphs.line(s, d, edge_values=("l_quantity", lambda _: F.round(F.col("l_tax") * 100))).network
    return paths.path(net, "o0", "o1", weighted=True).agg(F.max("distance").alias("distance"))


def pa_absent(s: SparkSession, d: str) -> DataFrame:
    return paths.path(graphs.geo(s, d).network, "s0", "nowhere")


# ---- sources and sinks


def io_network(s: SparkSession, d: str) -> DataFrame:
    """The geo graph stored and read again."""
    path = new_path(s)
    graphs.write_network(graphs.geo(s, d).network, path)
    return graphs.read_network(s, path).edges.select("id", "src", "dst")


def io_rows(s: SparkSession, d: str) -> DataFrame:
    """The nations written in each format and read again with their schema."""
    nations, out = read(s, d, "nation"), []
    for kind in ("parquet", "orc", "json", "csv"):
        path = new_path(s)
        nations.write.format(kind).save(path)
        out.append(graphs.read_rows(s, path, kind, nations.schema).select(F.lit(kind).alias("kind"), "n_nationkey", "n_name", "n_regionkey"))
    return reduce(DataFrame.unionByName, out)


def io_provider(s: SparkSession, d: str) -> DataFrame:
    """Rows of a generator, up to its first false one."""
    rows = ((i, f"x{i}") if i < 1000 else None for i in range(1010))
    return graphs.rows_of(s, rows, "id bigint, name string")


# ---- predicates


def fn_presence(s: SparkSession, d: str) -> DataFrame:
    """Per edge of iedge what of it is there."""
    e = read(s, d, "iedge")
    flags = {"has_id": presence.is_identifier(F.col("id")), "has_ends": presence.is_identifier(F.col("a")) & presence.is_identifier(F.col("b")), "has_atob": presence.is_weights(F.col("atob")), "one_atob": presence.is_weight_number(F.col("atob"), F.size("atob") == 1), "has_number": presence.list_present(F.col("btoa")), "has_kind": presence.is_defined(F.col("meta.kind")), "has_name": presence.text_present(F.col("meta.kind"))}
    return e.groupBy(*[c.alias(k) for k, c in flags.items()]).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {name: f for name, f in list(globals().items()) if name[:3] in ("mk_", "lk_", "mu_", "cl_", "so_", "nb_", "sp_", "sh_", "pa_", "io_", "fn_")}

# ---- SQL

_GEO_NODES = """(select 'r' || r_regionkey as id, r_name as name from region union all select 'n' || n_nationkey, n_name from nation
  union all select 's' || s_suppkey, s_name from supplier union all select 'c' || c_custkey, c_name from customer)"""
_GEO = """(select 'rn' || n_nationkey as id, 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation
  union all select 'ns' || s_suppkey, 'n' || s_nationkey, 's' || s_suppkey from supplier
  union all select 'nc' || c_custkey, 'n' || c_nationkey, 'c' || c_custkey from customer)"""
_SUPPLY = """(select 's' || l_suppkey || '-p' || l_partkey as id, 's' || l_suppkey as src, 'p' || l_partkey as dst, round(min(l_discount) * 100) as ab
  from lineitem where l_quantity >= 50 group by l_suppkey, l_partkey)"""
_TRADE = "(select distinct 'c' || o_custkey || '-s' || l_suppkey as id, 'c' || o_custkey as src, 's' || l_suppkey as dst from lineitem join orders on l_orderkey = o_orderkey)"
_EVENT = "(select id, src, dst from (select cast(event_id as varchar) as id, event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events) where dst is not null)"
_CHAIN = "(select id, src, dst from (select cast(o_orderkey as varchar) as id, cast(o_orderkey as varchar) as src, cast(lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as varchar) as dst from orders) where dst is not null)"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_LINE = f"(select *, l_orderkey || '-' || l_linenumber as id, 'o' || l_orderkey as src, 'p' || l_partkey as dst, row_number() over (order by {_ORDER}) as ord from lineitem)"
_ORPHAN = "p_partkey in (select p_partkey from part where p_size <= 25)"
_SOME = f"(select * from {_LINE} where l_partkey in (select p_partkey from part where p_size <= 25))"


def _bfs(edges: str, seeds: str, depth: int, without: str = "") -> str:
    skip = f" and m not in ({without})" if without else ""
    return f"""adj as (select src as n, dst as m, id from {edges} union all select dst, src, id from {edges}),
  walk as ({seeds} union select m, depth + 1 from walk join adj on n = node where depth < {depth}{skip}),
  dist as (select node, min(depth) as depth from walk group by 1)"""


def _seed(*ids: str) -> str:
    return " union all ".join(f"select '{i}' as node, 0 as depth" for i in ids)


def _depth_sql(edges: str, seeds: str, depth: int) -> str:
    return f"with recursive {_bfs(edges, seeds, depth)} select node, depth from dist"


_EDGE_DEPTH = "least(a.depth, b.depth) + 1 as depth"
_AGG = f"""a as (select *, case when l_returnflag = 'R' then [l_quantity] else [l_quantity, case when l_tax > 0 then l_tax end] end as v from {_LINE})"""
_HALF = lambda cond: (f"(select id from {_GEO_NODES} where not (id[1] = 'n' and {cond.format(k='cast(id[2:] as int)')}))", f"(select * from {_GEO} where not ((dst[1] = 'n' and {cond.format(k='cast(dst[2:] as int)')}) or (src[1] = 'n' and {cond.format(k='cast(src[2:] as int)')})))")
_N1, _E1 = _HALF("{k} < 8")
_N2, _E2 = _HALF("{k} > 16")
_MORE = """(select 'sr' || s_suppkey as id, 's' || s_suppkey as src, 'r' || n_regionkey as dst from supplier join nation on s_nationkey = n_nationkey)"""
_PAIR = _seed("s0"), _seed("s1")
_NEAR = f"""e as {_TRADE}, adj as (select src as n, dst as m from e union all select dst, src from e),
  walk as (select x as source, x as node, 0 as depth from (values ('s0'), ('s1')) t(x) union select source, m, depth + 1 from walk join adj on n = node where depth < 1),
  near as (select node from walk group by 1 having count(distinct source) = 2), shared as (select node from near where node not in ('s0', 's1'))"""

_TWO = f"""e as {_SUPPLY}, adj as (select src as n, dst as m from e union all select dst, src from e),
  zero as (select 's0' as node, 0 as depth union select m, depth + 1 from zero join adj on n = node where depth < {{}}), d0 as (select node, min(depth) as depth from zero group by 1),
  one as (select 's1' as node, 0 as depth union select m, depth + 1 from one join adj on n = node where depth < {{}}), d1 as (select node, min(depth) as depth from one group by 1)"""
#: Depth to which recursive SQL follows a spread to its end.
_END = 40
_PARENTS = "select b.node, arg_min(a.node, (a.node, id)) as parent, arg_min(id, (a.node, id)) as edge_id from dist a join adj on n = a.node join dist b on b.node = m and b.depth = a.depth + 1 group by 1"


def _multi_id(lists: str) -> str:
    return f"""with x as ({lists}), e as (select doc_id, unnest(range(len(v))) as pos, unnest(v) as t from x where v is not null union all select doc_id, 0, null from x where v is null),
  n as (select doc_id, pos, cast(row_number() over (order by doc_id, pos) - 1 as varchar) as t from e where t is null or t in ('', 'NaN')),
  u as (select * from e where t is not null and t not in ('', 'NaN') union all select * from n)
select t as id, cast(arg_max(doc_id, (doc_id, pos)) as double) as last_doc from u group by 1"""


SQL = {
    "io_network": f"select id, src, dst from {_GEO}",
    "io_rows": "select kind, n_nationkey, n_name, n_regionkey from nation, (select unnest(['parquet', 'orc', 'json', 'csv']) as kind)",
    "io_provider": "select range as id, 'x' || range as name from range(1000)",
    "fn_presence": """select id is not null as has_id, a is not null and b is not null as has_ends, coalesce(len(atob) > 0, false) as has_atob, coalesce(len(atob) = 1, false) as one_atob,
  coalesce(len(list_filter(btoa, lambda x: x is not null and not isnan(x))) > 0, false) as has_number, meta.kind is not null as has_kind, coalesce(regexp_matches(meta.kind, '[A-Za-z]'), false) as has_name, count(*) as n from iedge group by all""",
    "mk_nodes_geo": f"select id, name from {_GEO_NODES}",
    "mk_edges_geo": f"select id, src, dst from {_GEO}",
    "mk_dup_edges_last": f"select id, src, dst, l_quantity as ab, l_tax as ba from {_LINE} qualify row_number() over (partition by id order by ord desc) = 1",
    "mk_dup_edge_errors": f"select 'DUPLICATE_EDGE_ID' as error, id as entity_id, count(*) - 1 as n_errors from {_LINE} group by id having count(*) > 1",
    "mk_dup_node_last": "select cast(o_custkey as varchar) as id, o_totalprice as value from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "mk_dup_node_errors": "select 'DUPLICATE_NODE_ID' as error, cast(o_custkey as varchar) as entity_id, count(*) - 1 as n_errors from orders group by o_custkey having count(*) > 1",
    "mk_orphan_edges": f"select id, src, dst from {_SOME} qualify row_number() over (partition by id order by ord desc) = 1",
    "mk_orphan_errors": f"select 'NODE_NOT_FOUND' as error, id as entity_id, 'Could not find node b for this edge' as message, count(*) as n_errors from {_LINE} where l_partkey not in (select p_partkey from part where p_size <= 25) group by id",
    "mk_suppressed_errors": f"select 'NODE_NOT_FOUND' as error, count(*) as n_errors from {_LINE} where l_partkey not in (select p_partkey from part where p_size <= 25)",
    "mk_autoid": "select case when c_acctbal >= 0 then c_name else cast(row_number() over (partition by c_acctbal >= 0 order by c_custkey) - 1 as varchar) end as id, c_name as name from customer",
    "mk_multi_id": _multi_id("select doc_id, tags as v from documents"),
    "mk_multi_id_missing": _multi_id("""select doc_id, case when post_type is distinct from 'question' then list_transform(tags, lambda t: case when regexp_matches(t, '^[aeiou]') then ''
  when not regexp_matches(t, '[0-9]') then t end) end as v from documents"""),
    "mk_edge_guard": f"select id, case when l_tax > 0 then 1 else 0 end as n_ab, case when l_tax > 0 then 1 else 0 end as n_ba from {_LINE} qualify row_number() over (partition by id order by ord desc) = 1",
    "mk_agg_errors": f"""select 'BAD_ID' as error, cast(null as varchar) as entity_id, 'An edge was generated that has an invalid ID' as message, count(*) as n_errors, cast(count(*) as bigint) as n_sources
  from lineitem where l_returnflag = 'R' having count(*) > 0
union all select 'NODE_NOT_FOUND', id, 'Could not find node b for this edge', 1, cast(sum(case when l_returnflag = 'R' then 1 else 2 end) as bigint) from {_LINE}
  group by id having not bool_or(l_partkey in (select p_partkey from part where p_size <= 25))""",
    "mk_map_meta": "select cast(o_custkey as varchar) as id, o_orderpriority as priority, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders group by o_custkey, o_orderpriority",
    "mk_agg_none": f"with {_AGG}, x as (select id, arg_max(v, ord) as v from a group by 1) select id, cast(unnest(range(len(v))) as int) as pos, unnest(v) as w from x",
    "mk_agg_override": f"""with {_AGG}, p as (select id, ord, unnest(range(len(v))) as pos, unnest(v) as w from a)
select id, cast(pos as int) as pos, arg_max(w, ord) filter (where w is not null) as w from p group by 1, 2""",
    "mk_agg_concat": f"""with {_AGG}, p as (select id, ord, unnest(range(len(v))) as k, unnest(v) as w from a)
select id, cast(row_number() over (partition by id order by ord, k) - 1 as int) as pos, w from p where w is not null""",
    "mk_agg_meta": """select cast(o_custkey as varchar) as id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status,
  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) filter (where o_orderstatus = 'F') as priority, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as value from orders group by o_custkey""",
    "mk_agg_partial_edges": f"select id, src, dst from {_SUPPLY}",
    "lk_get_edge": f"select id, src, dst from {_GEO} where src = 'r0' and dst = 'n0'",
    "lk_node": "select 'n3' as id, n_name as name from nation where n_nationkey = 3",
    "lk_edge": f"select id, src, dst from {_GEO} where id = 'rn3'",
    "lk_get_edges": f"select p.a, p.b, e.id as edge_id from (select distinct dst as a, src as b from {_EVENT} union all select 'click', 'nowhere') p left join (select src, dst, max(id) as id from {_EVENT} group by 1, 2) e on e.src = p.a and e.dst = p.b",
    "lk_has_node": "select 'n' || (n_nationkey + 10) as id, n_nationkey + 10 in (select n_nationkey from nation) as is_member from nation",
    "lk_atob_last": f"select src, dst, max(id) as edge_id from {_EVENT} group by 1, 2",
    "mu_add_edge": f"select id, src, dst from {_GEO} union all select id, src, dst from {_MORE}",
    "mu_add_edge_errors": "select 'edge' as kind, 'rn' || n_nationkey as entity_id, 'Edge already exists' as message from nation",
    "mu_added_before": "select 'edge' as kind, 'rn' || n_nationkey as entity_id, 'Edge already exists' as message from nation where n_nationkey > 2",
    "mu_removed_before": "select 'edge' as kind, 'ns' || c_custkey as entity_id, 'Edge does not exist' as message from customer where c_custkey not in (select s_suppkey from supplier) and c_custkey > 99",
    "mu_add_node": f"select 'node' as kind, id from {_GEO_NODES} union all select distinct 'node', c_mktsegment from customer union all select 'edge', id from {_GEO} union all select 'edge', 'm' || c_custkey from customer",
    "mu_remove_edge": f"select id, src, dst from {_GEO} where id not in (select 'ns' || c_custkey from customer)",
    "mu_remove_edge_errors": "select 'edge' as kind, 'ns' || c_custkey as entity_id, 'Edge does not exist' as message from customer where c_custkey not in (select s_suppkey from supplier)",
    "mu_remove_node": f"""with g as (select 'n' || n_nationkey as id from nation where n_regionkey < 2)
select 'node' as kind, id from {_GEO_NODES} where id not in (select id from g) union all select 'edge', id from {_GEO} where src not in (select id from g) and dst not in (select id from g)""",
    "mu_removed_edges": f"""with g as (select 'n' || n_nationkey as id from nation where n_regionkey < 2)
select id, case when src in (select id from g) then 'out' else 'in' end as dir from {_GEO} where src in (select id from g) or dst in (select id from g)""",
    "cl_node": "select 'copy' as id, n_name as name from nation where n_nationkey = 0",
    "cl_edge": f"select 'copy' as id, src, dst from {_GEO} where id = 'rn0'",
    "cl_network": f"select id, src, dst from {_GEO}",
    "so_intersect_nodes": f"select id from {_N1} intersect select id from {_N2}",
    "so_intersect_edges": f"select id, src, dst from {_E1} intersect select id, src, dst from {_E2}",
    "so_union_nodes": f"select id from {_N1} union select id from {_N2}",
    "so_union_edges": f"select id, src, dst from {_E1} union select id, src, dst from {_E2}",
    "nb_all": f"select dst as node, src as nbr, id as edge_id, 'in' as dir from {_GEO} where dst[1] = 'n' union all select src, dst, id, 'out' from {_GEO} where src[1] = 'n'",
    "nb_exclude": f"select dst as node, src as nbr from {_GEO} where dst in ('n0', 'n1') union all select src, dst from {_GEO} where src in ('n0', 'n1') and dst[1] <> 's'",
    "nb_exclude_edges": f"select dst as node, src as nbr, id as edge_id, 'in' as dir from {_GEO} where dst in ('n0', 'n1') union all select src, dst, id, 'out' from {_GEO} where src in ('n0', 'n1')",
    "nb_event_multiplicity": f"select node, nbr, count(*) as n from (select dst as node, src as nbr from {_EVENT} union all select src, dst from {_EVENT}) group by 1, 2",
    "sp_depths": _depth_sql(_GEO, _seed("r0"), 6),
    "sp_layers": f"""with recursive {_bfs(_SUPPLY, _seed('s0'), _END)}, n as (select depth, count(*) as n_nodes from dist group by 1)
select depth, n_nodes from n union all select depth + 1, 0 from n where depth = (select max(depth) from n)
  and exists (select 1 from adj join dist a on a.node = n join dist b on b.node = m where a.depth = b.depth and a.depth = (select max(depth) from dist))""",
    "sp_paths": f"with recursive {_bfs(_SUPPLY, _seed('s0'), _END)} {_PARENTS}",
    "sp_tree_edges": f"with recursive {_bfs(_SUPPLY, _seed('s0'), _END)} select e.id as edge_id, {_EDGE_DEPTH} from {_SUPPLY} e join dist a on a.node = src join dist b on b.node = dst where a.depth <> b.depth",
    "sp_overlap": f"""with recursive e as {_SUPPLY}, adj as (select src as n, dst as m from e union all select dst, src from e),
  walk as (select x as source, x as node from (values ('s0'), ('s1'), ('s2')) t(x) union select source, m from walk join adj on n = node)
select node, count(*) as n_sources from walk group by 1 having count(*) > 1""",
    "sp_trade_layers": f"with recursive {_bfs(_TRADE, _seed('c0'), 8)} select depth, count(*) as n_nodes from dist group by 1",
    "sp_trade_paths": f"with recursive {_bfs(_TRADE, _seed('c0'), 8)} {_PARENTS}",
    "sp_chain_depths": f"with recursive {_bfs(_CHAIN, _seed('0'), _END)} select node, depth from dist",
    "sp_toward": f"with recursive {_bfs(_GEO, _seed('s0'), 8, 'select ' + chr(39) + 'c' + chr(39) + ' || c_custkey from customer')} select node, depth from dist",
    "sp_chunked": f"""with recursive {_bfs(_SUPPLY, _seed('s0'), _END)}, parent as ({_PARENTS}),
  rank as (select node, depth, (row_number() over (partition by depth order by node) - 1) // 20 as chunk from dist),
  part as (select r.depth + 1 as depth, r.chunk, count(p.node) as n_nodes from rank r left join parent p on p.parent = r.node where r.depth < (select max(depth) from dist) group by 1, 2
    union all select 0, 0, 1)
select cast(row_number() over (order by depth, chunk) - 1 as int) as part, depth, n_nodes from part""",
    "sp_waits": f"""with recursive {_bfs(_GEO, _seed('r0'), 8)}, walk1 as ({_seed('s0')} union select m, depth + 1 from walk1 join adj on n = node where depth < 8),
  dist1 as (select node, min(depth) as depth from walk1 group by 1),
  x as (select 0 as spread, depth, count(*) as n_nodes from dist group by 2 union all select 1, depth, count(*) from dist1 group by 2)
select cast(row_number() over (order by depth, spread) - 1 as int) as turn, spread, depth, n_nodes from x""",
    "sp_waits_others": f"""with recursive {_TWO.format(_END, _END)}, met as (select min(greatest(d0.depth, d1.depth)) as meet from d0 join d1 using (node) where d0.depth > 0),
  x as (select 0 as spread, depth, count(*) as n_nodes from d1 where depth <= coalesce((select meet from met), {_END}) group by 2 union all select 1, depth, count(*) from d0 group by 2)
select cast(row_number() over (order by depth, spread) - 1 as int) as turn, spread, depth, n_nodes from x""",
    "sp_layering_completely": f"""with recursive {_TWO.format(4, 2)}, met as (select min(d0.depth) as meet from d0 join d1 using (node) where d0.depth > 0)
select node, depth from d0 where depth <= coalesce((select meet from met), 4)""",
    "sp_layering_others": f"with recursive {_TWO.format(4, 2)} select distinct cast(0 as int) as spread from d0 join d1 using (node) where d0.depth > 0",
    "sp_multi_seed": _depth_sql(_GEO, _seed("n0", "n1", "s2"), 6),
    "sp_maxdepth": _depth_sql(_TRADE, _seed("c0"), 2),
    "sp_edges": f"with recursive {_bfs(_GEO, _seed('s0'), 6)} select e.id as edge_id, {_EDGE_DEPTH} from {_GEO} e join dist a on a.node = src join dist b on b.node = dst",
    "sp_no_same_depth": f"with recursive {_bfs(_EVENT, _seed('click'), 3)} select e.id as edge_id, {_EDGE_DEPTH} from {_EVENT} e join dist a on a.node = src join dist b on b.node = dst where a.depth <> b.depth",
    "sp_stop": f"with recursive {_bfs(_GEO, _seed('s0'), 2)} select depth, count(*) as n_nodes, true as cleared from dist group by 1",
    "sp_layering_blends": _depth_sql(_SUPPLY, _seed("s0"), 4),
    "sp_layering_overrides": f"""with recursive e as {_SUPPLY}, adj as (select src as n, dst as m from e union all select dst, src from e),
  walk as (select x as source, x as node, 0 as depth, y as lim from (values ('s0', 4), ('s1', 2)) t(x, y) union select source, m, depth + 1, lim from walk join adj on n = node where depth < lim)
select node from walk group by 1 having count(distinct source) = 2 and node <> 's0'""",
    "sp_layering_terminates": f"""with recursive e as {_SUPPLY}, adj as (select src as n, dst as m from e union all select dst, src from e),
  one as (select 's1' as node, 0 as depth union select m, depth + 1 from one join adj on n = node where depth < 2), o as (select distinct node from one),
  walk as (select 's0' as node, 0 as depth union select m, depth + 1 from walk join adj on n = walk.node where depth < 4 and m not in (select node from o))
select node, min(depth) as depth from walk group by 1""",
    "sh_connection_nodes": f"with recursive {_NEAR} select node from shared",
    "sh_connection_edges": f"with recursive {_NEAR} select id, src, dst from e where (src in (select node from shared) or src in ('s0', 's1')) and (dst in (select node from shared) or dst in ('s0', 's1'))",
    "pa_hops": f"""with recursive {_bfs(_TRADE, _seed('c0'), 4)}, back as (select node, depth from dist where node = 'c1'
  union all select (select min(a.node) from dist a join adj on n = a.node and m = back.node where a.depth = back.depth - 1), depth - 1 from back where depth > 0)
select depth as step, node, cast(depth as double) as distance from back""",
    "pa_weighted": f"""with recursive e as {_SUPPLY}, adj as (select src as n, dst as m, ab as w from e union all select dst, src, 1.0 from e),
  walk as (select 's0' as node, 0.0::double as d, 0 as hops union select m, min(d + w), hops + 1 from walk join adj on n = node where hops < 24 group by m, hops)
select min(d) as distance from walk where node = 's2'""",
    "pa_weighted_line": f"""with recursive e as (select id, src, dst, l_quantity as ab, round(l_tax * 100) as ba from {_LINE} qualify row_number() over (partition by id order by ord desc) = 1),
  adj as (select n, m, min(w) as w from (select src as n, dst as m, ab as w from e union all select dst, src, ba from e) group by 1, 2),
  walk as (select 'o0' as node, 0.0::double as d, 0 as hops union select m, min(d + w), hops + 1 from walk join adj on n = node where hops < 16 group by m, hops)
select min(d) as distance from walk where node = 'o1'""",
    "pa_absent": "select cast(null as int) as step, cast(null as varchar) as node, cast(null as double) as distance where false",
}
