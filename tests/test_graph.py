"""The hand-traced graph: A, B, C, D, E; e1 A->B, e2 A->C, e3 B->C, e4 C->D, e5 D->D, e6 B->A."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

import meshframe.plans.catalog as catalog
from meshframe.model import LayerPriority
from meshframe.operators import clone, lookup, mutate, paths, select, setops
from meshframe.operators.build import make_network
from meshframe.sources import graphs

EDGES = [("e1", "A", "B", 1.0), ("e2", "A", "C", 5.0), ("e3", "B", "C", 1.0), ("e4", "C", "D", 0.0), ("e5", "D", "D", 1.0), ("e6", "B", "A", 1.0)]


@pytest.fixture(scope="module")
def net(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABCDE"], "id string")
    edges = spark.createDataFrame(EDGES, "id string, a string, b string, w double")
    return make_network(nodes, edges, node_id="id", edge_id="id", edge_a="a", edge_b="b", edge_values=("w", "w"), node_order=["id"], edge_order=["id"]).network


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "node string")


def some(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


@pytest.mark.parametrize("node, exclude, keep, nodes, edges", [("A", None, False, "BBC", "e1 e2 e6"), ("D", None, False, "CDD", "e4 e5 e5"), ("A", "B", False, "C", "e2"), ("A", "B", True, "C", "e1 e2 e6"), ("E", None, False, "", "")])
def test_neighbors(spark, net, node, exclude, keep, nodes, edges):
    n, e = select.neighbors(net, ids(spark, node), ids(spark, exclude) if exclude else None, keep)
    assert sorted(r.nbr for r in n.collect()) == list(nodes)
    assert sorted(r.edge_id for r in e.collect()) == edges.split()


def layers(spark, net, start, **more):
    out = []
    for x in select.spread_layers(net, ids(spark, *start), **more):
        out.append(("".join(sorted(r.node for r in x.nodes.collect())), " ".join(sorted(r.edge_id for r in x.edges.collect())) if x.edges else ""))
    return out


def test_spread(spark, net):
    assert layers(spark, net, "A") == [("A", ""), ("BC", "e1 e2 e6"), ("D", "e3 e4"), ("", "e5")]
    assert layers(spark, net, "A", exclude_same_depth_edges=True) == [("A", ""), ("BC", "e1 e2 e6"), ("D", "e4"), ("", "")]
    assert layers(spark, net, "A", max_depth=1) == [("A", ""), ("BC", "e1 e2 e6")]
    assert layers(spark, net, "A", max_depth=0) == [("A", "")]
    assert layers(spark, net, "Z") == []
    parents = {}
    for x in select.spread_layers(net, ids(spark, "A"), keep_path=True):
        parents |= {r.node: r.parent for r in x.path.collect()} if x.path else {}
    assert parents == {"B": "A", "C": "A", "D": "C"}
    assert [n for n, _ in layers(spark, net, "A", max_nodes_per_execution=1)] == ["A", "BC", "", "D", ""]
    assert [n for n, _ in layers(spark, net, "A", toward=lambda c: F.col("node") != "C")][:2] == ["A", "B"]


def test_stop_and_layers(spark, net):
    seen = []
    state = select.spread(net, ids(spark, "A"), lambda x: seen.append(x.depth) or {"stop": x.depth == 1})
    assert seen == [0, 1] and state.visited_nodes is None
    first = select.spread(net, ids(spark, "D"), max_depth=1)  # D, C
    run = lambda p: select.spread(net, ids(spark, "A"), layers=[first], priority=p)
    nodes = lambda s: sorted(r.node for r in s.visited_nodes.collect())
    assert nodes(run(LayerPriority.BLENDS)) == list("ABCD")
    assert nodes(run(LayerPriority.TERMINATES)) == list("AB")
    assert nodes(run(LayerPriority.COMPLETELY_TERMINATES)) == list("ABC")
    assert run(LayerPriority.TERMINATES_OTHERS).cancelled == {0}
    assert sorted(r.node for r in run(LayerPriority.OVERRIDES).overridden.collect()) == list("CD")
    steps = [k for k, _ in select.in_lock_step(select.spread_layers(net, ids(spark, "A"), max_depth=1), select.spread_layers(net, ids(spark, "D"), max_depth=1))]
    assert steps == [0, 1, 0, 1]


def test_shared_and_overlap(spark, net):
    nodes, edges = select.shared_connection(net, ids(spark, "A", "D"), 1)
    assert rows(nodes) == [("C",)] and sorted(r.id for r in edges.collect()) == ["e2", "e4", "e5"]
    both = select.overlap(select.spread(net, ids(spark, "A", "D"), by_source=True, max_depth=1))
    assert rows(both) == [("C", 2)]


def test_paths(spark, net):
    assert [(r.node, r.distance) for r in paths.path(net, "A", "D").orderBy("step").collect()] == [("A", 0), ("C", 1), ("D", 2)]
    assert [(r.node, r.distance) for r in paths.path(net, "A", "D", weighted=True, directed=True).orderBy("step").collect()] == [("A", 0), ("B", 1), ("C", 2), ("D", 2)]
    assert rows(paths.path(net, "A", "A")) == [(0, "A", 0.0)]
    assert rows(paths.path(net, "A", "E")) == rows(paths.path(net, "A", "Z")) == rows(paths.path(net, "D", "A", directed=True)) == []


def test_lookups(spark, net):
    edge = lambda a, b: [r.id for r in lookup.get_edge(net, a, b).collect()]
    assert (edge("A", "B"), edge("B", "A"), edge("A", "D")) == (["e1"], ["e6"], [])
    assert lookup.has_node(net, ["A", "E"]) and not lookup.has_node(net, ["A", "Z"]) and lookup.has_node(net, [])
    assert rows(lookup.has_nodes(net, some(spark, "A", "Z", None))) == [("A", True), ("Z", False), (None, False)]


def test_mutation(spark, net):
    new = net.edges.where("id = 'e1'").withColumn("id", F.lit("e7")).withColumn("ord", F.struct(F.lit("e7").alias("id")))
    grown = mutate.add_edge(net, new).network
    assert [r.id for r in lookup.get_edge(grown, "A", "B").collect()] == ["e7"]
    assert [r.id for r in lookup.get_edge(mutate.remove_edge(grown, some(spark, "e7")).network, "A", "B").collect()] == ["e1"]
    again = net.edges.where("id = 'e1'")
    assert [r.entity_id for r in mutate.add_edge(net, again).errors.collect()] == ["e1"]
    assert mutate.add_edge(net, again, added=again).errors.isEmpty()
    gone = mutate.remove_edge(net, some(spark, "e2", "e9"))
    assert [r.id for r in gone.edges.collect()] == ["e2"] and [r.entity_id for r in gone.errors.collect()] == ["e9"]
    less = mutate.remove_node(net, some(spark, "C", "Z"))
    assert sorted(r.id for r in less.network.nodes.collect()) == list("ABDE")
    assert sorted(r.id for r in less.network.edges.collect()) == ["e1", "e5", "e6"]
    assert sorted(r.id for r in less.edges.collect()) == ["e2", "e3", "e4"] and [r.entity_id for r in less.errors.collect()] == ["Z"]
    back = mutate.add_node(less.network, net.nodes.where("id = 'C'"), net.edges).network
    assert rows(back.edges.select("id", "src", "dst")) == rows(net.edges.select("id", "src", "dst"))
    stray = new.withColumn("dst", F.lit("Z"))
    assert [r.entity_id for r in mutate.add_edge(net, stray, validate=True).errors.collect()] == ["e7"]


def test_clones_and_sets(spark, net):
    assert rows(clone.clone_node(net, "A", "N").select("id")) == [("N",)] and rows(clone.clone_edge(net, "e1").select("id", "src")) == [("e1", "A")]
    copy = clone.clone_network(net, written=True)
    assert rows(copy.nodes.select("id")) == rows(net.nodes.select("id"))
    a, b = mutate.remove_node(net, some(spark, "A")).network, mutate.remove_node(net, some(spark, "D")).network
    both, either = setops.intersection(a, b), setops.union(a, b)
    assert sorted(r.id for r in both.nodes.collect()) == list("BCE") and [r.id for r in both.edges.collect()] == ["e3"]
    assert sorted(r.id for r in either.nodes.collect()) == list("ABCDE") and either.edges.count() == 6


def test_spreads_to_the_end(spark):
    """Over the supply graph: golden layers of SURVEY 7.3, and plain Python."""
    tables = "/root/testdata/sf0.01"
    golden = [1, 13, 3, 37, 14, 147, 50, 452, 30, 227, 1, 4, 1, 7]
    sizes = [r.n_nodes for r in catalog.sp_layers(spark, tables).orderBy("depth").collect()]
    assert [n for n in sizes if n] == golden
    tables = "/root/testdata/sf0.001"
    edges = [(r.id, r.src, r.dst) for r in graphs.supply(spark, tables).network.edges.select("id", "src", "dst").collect()]

    def depths(start):
        out, front = {start: 0}, {start}
        while front:
            front = {y for _, a, b in edges for x, y in ((a, b), (b, a)) if x in front} - set(out)
            out |= {x: max(out.values()) + 1 for x in front}
        return out

    d = depths("s0")
    parents = {}
    for e, a, b in edges:
        for x, y in ((a, b), (b, a)):
            if x in d and d[y] == d[x] + 1:
                parents[y] = min(parents.get(y, ("~", "~")), (x, e))
    assert rows(catalog.sp_paths(spark, tables)) == sorted(((y, *p) for y, p in parents.items()), key=repr)
    assert rows(catalog.sp_tree_edges(spark, tables)) == sorted(((e, min(d[a], d[b]) + 1) for e, a, b in edges if a in d and d[a] != d[b]), key=repr)
    reached = [set(depths(x)) for x in ("s0", "s1", "s2")]
    n = {x: sum(x in r for r in reached) for x in set().union(*reached)}
    assert rows(catalog.sp_overlap(spark, tables)) == sorted(((x, k) for x, k in n.items() if k > 1), key=repr)
    parts = catalog.sp_chunked(spark, tables).collect()
    assert sum(r.n_nodes for r in parts) == len(d) and max(r.depth for r in parts) >= max(d.values())


def test_many_parts_few_jobs(spark, monkeypatch):
    """s0 - 2,000 parts - a supplier each: parts of 20 nodes are 102 in three layers, which don't take a job each."""
    nodes = spark.createDataFrame([("s0",)] + [(f"{c}{i}",) for c in "pt" for i in range(2000)], "id string")
    edges = spark.createDataFrame([(f"{x}{i}", *e) for i in range(2000) for x, e in (("a", ("s0", f"p{i}")), ("b", (f"t{i}", f"p{i}")))], "id string, a string, b string")
    made = make_network(nodes, edges, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_order=["id"], edge_order=["id"], ids_complete=True)
    monkeypatch.setattr(catalog.graphs, "supply", lambda *_: made)
    spark.range(1).count()
    last = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    first = last()
    parts = sorted(tuple(r) for r in catalog.sp_chunked(spark, "").select("part", "depth", "n_nodes").collect())
    jobs = last() - first
    assert parts == [(0, 0, 1), (1, 1, 2000), *[(2 + k, 2, 20) for k in range(100)]]
    assert 0 < jobs < len(parts), jobs


@pytest.mark.parametrize(("by_source", "few"), [(False, True), (True, True), (False, False), (True, False)])
def test_parts_marked_and_apart(spark, monkeypatch, by_source, few):
    """Marked parts are the parts that come one by one, and plain Python's: a ring with chords, whose layers have edges inside."""
    if not few:
        monkeypatch.setattr(select, "BROADCAST_ROWS", 2)
    n, size = 24, 3
    name = lambda i: f"n{i % n:02}"
    edges = [(f"e{i:02}", name(i), name(i + 1)) for i in range(n)] + [(f"f{i:02}", name(i), name(i * 5 + 2)) for i in range(n)]
    net = make_network(spark.createDataFrame([(name(i),) for i in range(n)], "id string"), spark.createDataFrame(edges, "id string, a string, b string"), node_id="id", edge_id="id", edge_a="a", edge_b="b", node_order=["id"], edge_order=["id"]).network
    start = ids(spark, "n00", "n07")
    options = {"by_source": by_source, "keep_path": True, "max_nodes_per_execution": size}

    want = []  # (depth, chunk, path, edges), layer after layer
    depth = {(s if by_source else "*", s): 0 for s in ("n00", "n07")}
    front, seen = set(depth), set()
    while front:
        chunk = {x: k // size for k, x in enumerate(sorted({x for _, x in front}))}
        k, found, taken = len({d for d, *_ in want}) + 1, {}, {}
        for e, a, b in edges:
            for x, y in ((a, b), (b, a)):
                for s in {s for s, v in front if v == x}:
                    if (s, e) not in seen:
                        taken[s, e] = min(taken.get((s, e), n), chunk[x])
                    if (s, y) not in depth:
                        found[s, y] = min(found.get((s, y), ("~", "~")), (x, e))
        if not taken:
            break
        for c in range(max(chunk.values()) + 1 if found else 1):
            want.append((k, c, sorted((*y, *f) for y, f in found.items() if chunk[f[0]] == c), sorted(x for x, at in taken.items() if not found or at == c)))
        seen |= set(taken)
        depth |= dict.fromkeys(found, k)
        front = set(found)

    apart = [(x.depth, rows(x.path), sorted((r.source, r.edge_id) for r in x.edges.collect())) for x in select.spread_layers(net, start, **options) if x.depth]
    assert apart == [(d, p, e) for d, _, p, e in want]
    marked = []
    for x in select.spread_layers(net, start, mark_parts=True, **options):
        path, found = (x.path.collect(), x.edges.collect()) if x.depth else ([], [])
        assert x.depth or (x.n_parts == 1 and {r.chunk for r in x.nodes.collect()} == {0})
        for c in range(x.n_parts if x.depth else 0):
            marked.append((x.depth, c, sorted((r.source, r.node, r.parent, r.edge_id) for r in path if r.chunk == c), sorted((r.source, r.edge_id) for r in found if r.chunk == c)))
            assert rows(x.nodes.where(F.col("chunk") == c).select("source", "node")) == sorted(p[:2] for p in marked[-1][2])
    assert marked == want and max(c for _, c, *_ in want) > 1


def test_layered_in_lock_step(spark):
    """Two spreads over a chain 0 - 1 - ... - 9, from 0 and from 6: they meet while both still run."""
    nodes = spark.createDataFrame([(str(i),) for i in range(10)], "id string")
    edges = spark.createDataFrame([(f"e{i}", str(i), str(i + 1)) for i in range(9)], "id string, a string, b string")
    chain = make_network(nodes, edges, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_order=["id"], edge_order=["id"]).network

    def run(priority):
        one, two = select.SpreadState(), select.SpreadState()
        steps = select.in_lock_step(select.spread_layers(chain, ids(spark, "0"), state=one), select.spread_layers(chain, ids(spark, "6"), state=two, layers=[one], priority=priority))
        assert max(k for k, _ in steps) == 1
        return one, two, *(["".join(sorted(r.node for r in x.visited_nodes.collect())) for x in (one, two)])

    assert run(LayerPriority.BLENDS)[2:] == ("0123456789",) * 2
    one, two, a, b = run(LayerPriority.TERMINATES_OTHERS)  # both reach 3 in their third round
    assert (one.ended, two.cancelled, a, b) == (True, {0}, "0123", "0123456789")
    one, two, a, b = run(LayerPriority.OVERRIDES)
    assert (a, b) == ("0123", "0123456789") and sorted(r.node for r in two.overridden.collect()) == list("0123")
    assert run(LayerPriority.TERMINATES)[2:] == ("0123456789", "456789")
    assert run(LayerPriority.COMPLETELY_TERMINATES)[3] == "3456789"
