import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from meshframe.functions import weights
from meshframe.model import ErrorType, ValueMode
from meshframe.operators import build
from meshframe.operators.build import make_network
from meshframe.operators.index import dense_index

NONE = None


def built(spark, nodes, edges, **more):
    n = spark.createDataFrame(nodes, "id string, v double, k int")
    e = spark.createDataFrame(edges, "id string, a string, b string, k int")
    return make_network(n, e, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_values="v", node_order=["k"], edge_order=["k"], **more)


def test_duplicate_nodes_last_wins(spark):
    r = built(spark, [("x", 1.0, 0), ("y", 2.0, 1), ("x", 0.0, 2)], [])
    got = r.network.nodes.orderBy("ord").collect()
    assert [(x.id, x.value) for x in got] == [("y", [2.0]), ("x", [0.0])]
    (e,) = r.errors.collect()
    assert e.error == "DUPLICATE_NODE_ID" and [json.loads(s)["k"] for s in e.source] == [2, 0]
    assert built(spark, [("x", 1.0, 0), ("x", 2.0, 1)], [], suppress_errors=[ErrorType.DUPLICATE_NODE_ID]).errors.isEmpty()


def test_edges(spark):
    nodes = [("x", 1.0, 0), ("y", NONE, 1)]
    r = built(spark, nodes, [("k", "x", "y", 0), ("k", "x", "zz", 1), ("m", "q", "zz", 2), ("n", "q", "x", 3), ("d", "x", "x", 4), ("d", "y", "x", 5), ("o", NONE, "x", 6)])
    assert rows(r.network.edges.select("id", "src", "dst")) == [("d", "y", "x"), ("k", "x", "y")]
    assert rows(r.errors.select("error", "entity_id", "message")) == sorted(
        [
            ("DUPLICATE_EDGE_ID", "d", "Duplicate edge id: d"),
            ("NODE_NOT_FOUND", "k", "Could not find node b for this edge"),
            ("NODE_NOT_FOUND", "m", "Could not find either node for this edge"),
            ("NODE_NOT_FOUND", "n", "Could not find node a for this edge"),
            ("NODE_NOT_FOUND", "o", "Could not find node a for this edge"),
        ],
        key=repr,
    )


def test_aggregate(spark):
    r = built(spark, [("x", 1.0, 0), ("y", 1.0, 1), ("x", NONE, 2)], [("k", "x", NONE, 0), ("k", NONE, "y", 1), ("h", "x", NONE, 2), ("h", NONE, "zz", 3)], aggregate_results=True)
    assert [(x.id, x.value) for x in r.network.nodes.orderBy("ord").collect()] == [("x", [1.0]), ("y", [1.0])]
    assert rows(r.network.edges.select("id", "src", "dst")) == [("k", "x", "y")]
    (e,) = r.errors.collect()
    assert e.message == "Could not find node b for this edge" and len(e.source) == 2


def test_meta_merge(spark):
    n = spark.createDataFrame([("a", 1, 1, NONE, 0), ("a", NONE, 2, 3, 1)], "id string, p int, q int, r int, k int")
    e = spark.createDataFrame([], "id string, a string, b string")
    net = make_network(n, e, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_meta=lambda _: F.struct("p", "q", "r"), node_order=["k"], edge_order=["id"], aggregate_results=True).network
    assert tuple(net.nodes.first().meta) == (1, 2, 3)


def test_missing_and_listed_ids(spark):
    r = built(spark, [("", 1.0, 0), ("0", 2.0, 1), (NONE, 3.0, 2), ("NaN", 4.0, 3)], [(NONE, "0", "1", 0), (NONE, "1", "2", 1)])
    assert sorted((x.id, x.value[0]) for x in r.network.nodes.collect()) == [("0", 2.0), ("1", 3.0), ("2", 4.0)]
    assert rows(r.network.edges.select("id", "src", "dst")) == [("0", "0", "1"), ("1", "1", "2")]
    n = spark.createDataFrame([(["u", "v"], 1), ([], 2), (NONE, 3), (["v"], 4)], "ids array<string>, k int")
    e = spark.createDataFrame([], "id string, a string, b string")
    net = make_network(n, e, node_id="ids", node_values="k", edge_id="id", edge_a="a", edge_b="b", node_order=["k"], edge_order=["id"], ids_complete=True).network
    assert rows(net.nodes.select("id", "value")) == [("u", [1.0]), ("v", [4.0])]


def test_missing_ids_in_lists(spark):
    """A null list and null or empty entries are numbered in order of (row, place); an empty list makes nothing."""
    n = spark.createDataFrame([(["x", NONE, ""], 1), (NONE, 2), ([], 3), (["NaN", "y"], 4)], "ids array<string>, k int")
    e = spark.createDataFrame([(["e", NONE], "x", "0", 1), (NONE, "y", "3", 2), (["e"], "x", "y", 3)], "ids array<string>, a string, b string, k int")
    make = lambda **more: make_network(n, e, node_id="ids", node_values="k", edge_id="ids", edge_a="a", edge_b="b", node_order=["k"], edge_order=["k"], **more)
    r = make()
    assert rows(r.network.nodes.select("id", "value")) == [("0", [1.0]), ("1", [1.0]), ("2", [2.0]), ("3", [4.0]), ("x", [1.0]), ("y", [4.0])]
    assert rows(r.network.edges.select("id", "src", "dst")) == [("0", "x", "0"), ("1", "y", "3"), ("e", "x", "y")]
    assert [x.error for x in r.errors.collect()] == ["DUPLICATE_EDGE_ID"]
    merged = make(aggregate_results=True)  # a missing entry of an edge's list is an error there
    assert rows(merged.network.edges.select("id", "src", "dst")) == [("0", "y", "3"), ("e", "x", "y")]
    assert [(x.kind, x.error, x.entity_id, len(x.source)) for x in merged.errors.collect()] == [("edge", "BAD_ID", NONE, 1)]
    assert make(aggregate_results=True, suppress_errors=[ErrorType.BAD_ID]).errors.isEmpty()


def test_rows_without_id_are_errors(spark):
    """Where ids are said to be complete, a row without one is left out and reported."""
    r = built(spark, [("x", 1.0, 0), (NONE, 2.0, 1)], [("k", "x", "x", 0), ("", "x", "x", 1)], ids_complete=True)
    assert rows(r.network.nodes.select("id")) == [("x",)] and rows(r.network.edges.select("id")) == [("k",)]
    assert sorted((x.kind, x.error) for x in r.errors.collect()) == [("edge", "BAD_ID"), ("node", "BAD_ID")]
    whole = built(spark, [(NONE, 1.0, 0)], [("k", "x", NONE, 0)], ids_complete=True, aggregate_results=True)
    assert whole.network.nodes.isEmpty() and sorted((x.kind, x.error) for x in whole.errors.collect()) == [("edge", "NODE_NOT_FOUND"), ("node", "BAD_ID")]


def test_map_meta_merges_by_key(spark):
    n = spark.createDataFrame([("a", {"p": 1, "q": 1}, 0), ("a", {"q": 2, "r": 3, "p": NONE}, 1), ("b", NONE, 2), ("c", {}, 3)], "id string, m map<string,int>, k int")
    e = spark.createDataFrame([("e", "a", NONE, {"x": 1}, 0), ("e", NONE, "b", {"x": 2, "y": 3}, 1)], "id string, a string, b string, m map<string,int>, k int")
    net = make_network(n, e, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_meta="m", edge_meta="m", node_order=["k"], edge_order=["k"], aggregate_results=True).network
    assert {x.id: x.meta for x in net.nodes.collect()} == {"a": {"p": 1, "q": 2, "r": 3}, "b": NONE, "c": NONE}
    assert [(x.src, x.dst, x.meta) for x in net.edges.collect()] == [("a", "b", {"x": 2, "y": 3})]


def test_kinds_of_ids_differ(spark):
    n = spark.createDataFrame([(1,)], "id int")
    e = spark.createDataFrame([("1", "1", "1")], "id string, a string, b string")
    r = make_network(n, e, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_order=["id"], edge_order=["id"])
    assert r.network.edges.isEmpty() and [x.error for x in r.errors.collect()] == ["NODE_NOT_FOUND"]


def test_edge_values_need_both(spark):
    n = spark.createDataFrame([("x",)], "id string")
    e = spark.createDataFrame([("p", 0.0, 2.0), ("q", 1.0, NONE)], "id string, ab double, ba double")
    net = make_network(n, e, node_id="id", edge_id="id", edge_a=F.lit("x"), edge_b=F.lit("x"), edge_values=("ab", "ba"), node_order=["id"], edge_order=["id"]).network
    assert rows(net.edges.select("id", "atob", "btoa", "atob_is_scalar")) == [("p", [0.0], [2.0], True), ("q", [], [], False)]


@pytest.mark.parametrize(
    "mode, steps, want",
    [
        (ValueMode.OVERRIDE, [[1, 2, 3], [0, 1]], [0, 1, 3]),
        (ValueMode.OVERRIDE, [[1, 2, 3], [NONE, 1]], [1, 1, 3]),
        (ValueMode.OVERRIDE, [1, [2, 3, 4]], [2, 3, 4]),
        (ValueMode.OVERRIDE, [[1, 2, 3], 5], 5),
        (ValueMode.OVERRIDE, [[NONE, 2, 3], [1]], [1, 2, 3]),
        (ValueMode.OVERRIDE, [[1, 2, 3], 5, [NONE, 9]], [NONE, 9]),
        (ValueMode.CONCAT, [1, 2], [1, 2]),
        (ValueMode.CONCAT, [1, [2, 3]], [1, 2, 3]),
        (ValueMode.CONCAT, [[1, 2], 3], [1, 2, 3]),
        (ValueMode.CONCAT, [[1, NONE], [2]], [1, 2]),
        (ValueMode.NONE, [[1, 2], 5], 5),
        (ValueMode.NONE, [[1, 2], NONE], [1, 2]),
        (ValueMode.NONE, [[1, 2], []], [1, 2]),
    ],
)
def test_value_modes(spark, mode, steps, want):
    data = [("k", i, NONE if s is None else [float(x) if x is not None else None for x in (s if isinstance(s, list) else [s])], not isinstance(s, list)) for i, s in enumerate(steps)]
    x = spark.createDataFrame(data, "id string, ord int, v array<double>, s boolean")
    (r,) = weights.combine(x, mode, "v", "s").collect()
    assert (r.v, r.s) == ((want, False) if isinstance(want, list) else ([want], True))


def test_accessors(spark):
    """A name, a Column or a function of the frame; None is a null."""
    x = spark.createDataFrame([("a", 1)], "id string, k int")
    assert build.is_accessor_string("id") and not build.is_accessor_string(F.col("id"))
    got = x.select(*[build.access(x, a).alias(f"c{i}") for i, a in enumerate(("id", F.col("k") + 1, lambda df: df["k"] * 3, NONE))])
    assert rows(got) == [("a", 2, 3, NONE)]


def test_aggregates_have_no_duplicates(spark):
    """Duplicate ids are the point of the mode; deleting while processing changes nothing."""
    r = built(spark, [("x", 1.0, 0), ("x", 2.0, 1)], [("k", "x", "x", 0), ("k", "x", "x", 1)], aggregate_results=True, delete_while_processing=True)
    assert r.errors.isEmpty() and r.network.nodes.count() == r.network.edges.count() == 1


def test_dense_index(spark):
    x = dense_index(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5), ["x"], "n")
    assert x.where("x <> n").isEmpty() and x.count() == 1000
