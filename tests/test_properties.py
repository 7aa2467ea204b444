"""Random graphs against plain Python."""

from collections import defaultdict

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meshframe.operators import mutate, select, setops
from meshframe.operators.build import make_network

GRAPH = st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)
@given(GRAPH)
def test_graph(spark, pairs):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id int")
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a int, b int")
    net = make_network(nodes, edges, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_order=["id"], edge_order=["id"], ids_complete=True).network
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    depth, front = {pairs[0][0]: 0}, [pairs[0][0]]
    while front:
        nxt = sorted({m for n in front for m in adj[n]} - set(depth))
        depth |= {m: depth[front[0]] + 1 for m in nxt}
        front = nxt
    start = spark.createDataFrame([(str(pairs[0][0]),)], "node string")
    state = select.spread(net, start)
    assert {int(r.node): r.depth for r in state.visited_nodes.collect()} == depth
    assert sorted(int(r.edge_id) for r in state.visited_edges.collect()) == [i for i, (a, _) in enumerate(pairs) if a in depth]
    found = [(r.node, r.nbr) for r in select.neighbors(net, net.nodes.withColumnRenamed("id", "node"))[0].collect()]
    assert sorted(found) == sorted((b, a) for a, b in found) == sorted((str(x), str(y)) for p in pairs for x, y in (p, p[::-1]))
    cut_off = mutate.remove_node(net, start.withColumnRenamed("node", "id"))
    back = mutate.add_node(cut_off.network, cut_off.nodes, cut_off.edges.drop("dir")).network
    assert rows(back.edges.select("id", "src", "dst")) == rows(net.edges.select("id", "src", "dst"))
    both, either = setops.intersection(net, cut_off.network), setops.union(net, cut_off.network)
    assert set(rows(both.edges.select("id"))) <= set(rows(either.edges.select("id")))
    assert rows(either.nodes.select("id")) == rows(net.nodes.select("id"))
