"""Graphs from tables: rows of any readable format, and those of the supplied tables."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice, takewhile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshframe.model import Network
from meshframe.operators.build import NetworkResult, make_network
from meshframe.runtime import new_path, read


def tag(letter: str, c) -> F.Column:
    return F.concat(F.lit(letter), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


#: Rows of a provider that the driver holds at once.
CHUNK = 50_000


def rows_of(spark: SparkSession, source, schema=None) -> DataFrame:
    """Rows of a provider: a DataFrame, a list of rows, a generator or a function that gives rows until a false one.

    The driver holds CHUNK rows at a time: more are written to the shared folder as they come. Without a schema, that of
    the first chunk holds for all.
    """
    if isinstance(source, DataFrame):
        return source
    if callable(source):
        source = iter(source, None)
    if not isinstance(source, Iterable):
        raise TypeError("no rows")
    rows, path = takewhile(bool, source), ""
    while chunk := list(islice(rows, CHUNK)):
        x = spark.createDataFrame(chunk, schema)
        schema = x.schema
        if not path and len(chunk) < CHUNK:
            return x
        path = path or new_path(spark)
        x.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def read_rows(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """Rows from parquet, orc, json or csv files; the schema is declared for the text formats."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_network(net, path: str, kind: str = "parquet") -> None:
    """nodes and edges as tables below path."""
    net.nodes.write.format(kind).mode("overwrite").save(f"{path}/nodes")
    net.edges.write.format(kind).mode("overwrite").save(f"{path}/edges")


def read_network(spark: SparkSession, path: str, kind: str = "parquet") -> Network:
    """A network that write_network has stored: filters and columns of lookups reach its files."""
    return Network(spark.read.format(kind).load(f"{path}/nodes"), spark.read.format(kind).load(f"{path}/edges"))


def _made(nodes: DataFrame, edges: DataFrame, **more) -> NetworkResult:
    return make_network(nodes, edges, node_id="id", edge_id="id", edge_a="a", edge_b="b", node_order=["id"], edge_order=more.pop("edge_order", ["id"]), ids_complete=True, **more)


def _geo_nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = [read(spark, d, t).select(tag(x, k).alias("id"), n.alias("name")) for t, x, k, n in (("region", "r", "r_regionkey", F.col("r_name")), ("nation", "n", "n_nationkey", F.col("n_name")), ("supplier", "s", "s_suppkey", F.col("s_name")), ("customer", "c", "c_custkey", F.col("c_name")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _geo_edges(spark: SparkSession, d: str) -> DataFrame:
    rn = read(spark, d, "nation").select(tag("rn", "n_nationkey").alias("id"), tag("r", "n_regionkey").alias("a"), tag("n", "n_nationkey").alias("b"))
    ns = read(spark, d, "supplier").select(tag("ns", "s_suppkey").alias("id"), tag("n", "s_nationkey").alias("a"), tag("s", "s_suppkey").alias("b"))
    nc = read(spark, d, "customer").select(tag("nc", "c_custkey").alias("id"), tag("n", "c_nationkey").alias("a"), tag("c", "c_custkey").alias("b"))
    return rn.unionByName(ns).unionByName(nc)


def geo(spark: SparkSession, d: str) -> NetworkResult:
    """region -> nation -> supplier and customer."""
    return _made(_geo_nodes(spark, d), _geo_edges(spark, d), node_meta=lambda _: F.struct("name"))


def supply(spark: SparkSession, d: str) -> NetworkResult:
    """supplier -> part, distinct, of line items of 50 and more; weighted by the smallest discount in percent, and 1 back."""
    li = read(spark, d, "lineitem").where("l_quantity >= 50").groupBy("l_suppkey", "l_partkey").agg(F.min("l_discount").alias("w"))
    edges = li.select(F.concat(tag("s", "l_suppkey"), F.lit("-"), tag("p", "l_partkey")).alias("id"), tag("s", "l_suppkey").alias("a"), tag("p", "l_partkey").alias("b"), F.round(F.col("w") * 100).alias("ab"), F.lit(1.0).alias("ba"))
    nodes = read(spark, d, "supplier").select(tag("s", "s_suppkey").alias("id")).unionByName(read(spark, d, "part").select(tag("p", "p_partkey").alias("id")))
    return _made(nodes, edges, edge_values=("ab", "ba"))


def chain(spark: SparkSession, d: str) -> NetworkResult:
    """order -> the same customer's next order."""
    o = read(spark, d, "orders")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = o.select("o_orderkey", nxt.alias("nxt")).where("nxt is not null").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("a"), F.col("nxt").alias("b"))
    return _made(o.select(F.col("o_orderkey").alias("id")), edges)


def trade(spark: SparkSession, d: str) -> NetworkResult:
    """customer -> supplier, distinct, through orders and their line items."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    edges = pairs.select(F.concat(tag("c", "o_custkey"), F.lit("-"), tag("s", "l_suppkey")).alias("id"), tag("c", "o_custkey").alias("a"), tag("s", "l_suppkey").alias("b"))
    nodes = read(spark, d, "customer").select(tag("c", "c_custkey").alias("id")).unionByName(read(spark, d, "supplier").select(tag("s", "s_suppkey").alias("id")))
    return _made(nodes, edges)


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def line_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as edge rows o -> p; (order, line number) is the id and repeats."""
    li = read(spark, d, "lineitem")
    return li.withColumn("id", F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))).withColumn("a", tag("o", "l_orderkey")).withColumn("b", tag("p", "l_partkey"))


def line_nodes(spark: SparkSession, d: str, part_filter: str = "true") -> DataFrame:
    return read(spark, d, "orders").select(tag("o", "o_orderkey").alias("id")).unionByName(read(spark, d, "part").where(part_filter).select(tag("p", "p_partkey").alias("id")))


def line(spark: SparkSession, d: str, part_filter: str = "true", **more) -> NetworkResult:
    return _made(line_nodes(spark, d, part_filter), line_rows(spark, d), edge_order=LINE_ORDER, **more)


def event(spark: SparkSession, d: str) -> NetworkResult:
    """event type -> the type of the user's next event: self loops and parallel edges."""
    e = read(spark, d, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("a"), nxt.alias("b")).where("b is not null")
    return _made(e.select(F.col("event_type").alias("id")).distinct(), edges.withColumn("id", F.col("id").cast("string")), edge_order=["id"])
