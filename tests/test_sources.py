import pytest
from conftest import rows
from pyspark.sql import functions as F

from meshframe import runtime
from meshframe.functions import presence
from meshframe.operators import lookup as lookups
from meshframe.operators.build import make_network
from meshframe.runtime import checked_broadcast, cut, drop, hot_values, is_small, lookup
from meshframe.sources import graphs
from meshframe.sources.graphs import read_rows, rows_of, write_network
from meshframe.streaming.ingest import NetworkStore, ingest


def test_providers(spark):
    data = [("a", 1), ("b", 2)]
    want = sorted(data, key=repr)
    left = iter([*data, None, ("c", 3)])
    for source in (data, iter(data), (x for x in data), lambda: next(left), spark.createDataFrame(data, "id string, n int")):
        assert rows(rows_of(spark, source, "id string, n int")) == want
    assert rows(rows_of(spark, [], "id string")) == []
    with pytest.raises(TypeError):
        rows_of(spark, 5)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 1)], "id string, b string, n int")
    for kind, more in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": True})):
        df.write.format(kind).options(**more).save(f"{tmp_path}/{kind}")
        assert rows(read_rows(spark, f"{tmp_path}/{kind}", kind, df.schema, **more)) == rows(df)
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    net = make_network(n, df, node_id="id", edge_id="n", edge_a="id", edge_b="b", node_order=["id"], edge_order=["n"]).network
    write_network(net, f"{tmp_path}/net")
    assert rows(read_rows(spark, f"{tmp_path}/net/edges").select("id", "src", "dst")) == [("1", "a", "b")]


def test_stream_is_idempotent(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("id string, at timestamp")
    spark.sql("select 'a' as id, timestamp '2024-01-01 00:00:00' as at union all select 'b', timestamp '2024-01-01 01:00:00' union all select 'a', timestamp '2024-01-01 02:00:00'").write.parquet(f"{tmp_path}/in")
    store = NetworkStore(spark, f"{tmp_path}/store")
    none = F.expr("cast(array() as array<double>)")
    nodes = lambda x: x.select("id", none.alias("value"), F.lit(False).alias("value_is_scalar"))
    for _ in range(2):
        ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, nodes, None, f"{tmp_path}/progress", at="at").awaitTermination()
        assert rows(store.table("nodes").select("id")) == [("a",), ("b",)]
    store.add("nodes", nodes(spark.createDataFrame([("c",), ("a",)], "id string")), 7)
    store.add("nodes", nodes(spark.createDataFrame([("c",), ("a",)], "id string")), 7)
    assert rows(store.table("nodes").select("id")) == [("a",), ("b",), ("c",)] and store.table("edges").isEmpty()


def test_runtime(spark, monkeypatch):
    df = cut(spark.range(10), F.col("id") > 6)
    assert (df.n_rows, df.n_flagged, df.count()) == (10, 3, 10)
    empty = cut(spark.range(10).where("id < 0"))
    assert (empty.n_rows, empty.n_flagged) == (0, 0)
    drop(empty)
    assert is_small(df, 10) and not is_small(df, 9) and checked_broadcast(df).count() == 10
    facts = spark.createDataFrame([(1, "x")] * 9 + [(2, "y"), (None, "z"), (3, "w")], "k int, v string")
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")
    want = sorted([(1, "x", "one")] * 9 + [(2, "y", "two"), (None, "z", None), (3, "w", None)], key=repr)
    assert hot_values(facts, "k", 12) == []
    assert rows(lookup(facts, "k", dim, "k", "name", "name", 12, "left")) == want
    import meshframe.runtime as r

    monkeypatch.setattr(r, "hot_values", lambda *_: [1])
    assert rows(lookup(facts, "k", dim, "k", "name", "name", 12, "left")) == want


def test_predicates(spark):
    x = spark.createDataFrame([(0.0, [0.0], ""), (float("nan"), [], "a"), (None, None, None)], "n double, w array<double>, s string")
    got = x.select(presence.is_defined(F.col("n")), presence.is_identifier(F.col("n")), presence.is_identifier(F.col("s")), presence.is_weights(F.col("w")), presence.is_weight_number(F.col("w"), F.lit(True)), presence.number_present(F.col("n")))
    assert [tuple(r) for r in got.collect()] == [(True, True, False, True, True, True), (True, False, True, False, False, False), (False, False, False, False, False, False)]


def test_large_providers_and_stored_networks(spark, monkeypatch, tmp_path):
    """The driver holds a chunk of a provider's rows; a lookup in a stored network filters in the files."""
    monkeypatch.setattr(graphs, "CHUNK", 10)
    held = []

    def provider():
        for i in range(35):
            held.append(i)
            yield (f"n{i}", i)
        yield None
        raise AssertionError("read beyond the false row")

    assert sorted(r.k for r in graphs.rows_of(spark, provider(), "id string, k int").collect()) == list(range(35)) == held
    assert sorted(r.k for r in graphs.rows_of(spark, provider(), ["id", "k"]).collect()) == list(range(35))
    assert graphs.rows_of(spark, [], "id string").isEmpty() and graphs.rows_of(spark, iter([("a",)] * 10), "id string").count() == 10
    nodes, edges = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("e", "x", "y")], "id string, a string, b string")
    made = make_network(nodes, edges, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_order=["id"], edge_order=["id"]).network
    graphs.write_network(made, str(tmp_path / "net"))
    found = lookups.get_edge(graphs.read_network(spark, str(tmp_path / "net")), "x", "y")
    assert [r.id for r in found.collect()] == ["e"]
    assert "EqualTo(src,x)" in found._jdf.queryExecution().executedPlan().toString()


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(10).selectExpr("repeat('x', 1000) as t")
    assert runtime.is_small(wide) and not runtime.is_small(wide, size=5000) and not runtime.is_small(wide, rows=9)
