"""make_network: rows to a graph and its errors.

An accessor is a column name, a Column, or a function of the DataFrame that gives a Column. Missing ids (null, NaN, "")
are numbered from 0 in order, nodes and edges apart; 0 is a valid id and a valid weight. A list of ids repeats its row for
each of them. Rows are ordered by the columns of `order`, which should be a total order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.functions import weights as W
from meshframe.model import ErrorType, Network, ValueMode
from meshframe.operators.index import dense_index

Accessor = str | Column | Callable[[DataFrame], Column]


@dataclass(frozen=True)
class NetworkResult:
    """The network, and how to get its errors: their plan is made when they are asked for."""

    network: Network
    make_errors: Callable[[], DataFrame]

    @property
    def errors(self) -> DataFrame:
        return self.make_errors()


def access(df: DataFrame, accessor: Accessor | None) -> Column:
    """The Column that an accessor means; a null for None."""
    if accessor is None:
        return F.lit(None).cast("string")
    if isinstance(accessor, str):
        return F.col(accessor)
    return accessor if isinstance(accessor, Column) else accessor(df)


def is_accessor_string(accessor: Accessor) -> bool:
    return isinstance(accessor, str)


def _type(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c.alias("x")).schema["x"].dataType


def _kind(kind: T.DataType) -> str:
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return "n" if isinstance(kind, T.NumericType) else "s"


def identifier(c: Column, tag: str = "") -> Column:
    """An id as string; null if it is missing (null, "" or NaN)."""
    s = c.cast("string")
    s = F.when((s != "") & (s != "NaN"), s)
    return F.concat(F.lit(tag), s) if tag else s


def _rows(df: DataFrame, ids: Accessor | None, order: list[str], cols: dict[str, Column], tag: str, complete: bool, strict: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(id, ord, source, cols...): one row an id of a row, missing ids numbered; and the rows whose missing id is an error, if any may be.

    All rows without an id are errors if ids are said to be `complete`; if `strict`, only missing entries of a list of ids are.
    An empty list of ids makes no row, a null list is a missing id.
    """
    c = access(df, ids)
    many = ids is not None and isinstance(_type(df, c), T.ArrayType)
    keep = [F.to_json(F.struct(*[F.col(x) for x in df.columns])).alias("source"), *[v.alias(k) for k, v in cols.items()]]
    if many:
        x = df.where(c.isNull() | (F.size(c) > 0)).select(c.isNotNull().alias("__listed"), F.posexplode_outer(c).alias("__pos", "__id"), *order, *keep)
        x = x.select(identifier(F.col("__id"), tag).alias("id"), F.struct(*[F.col(o) for o in order], F.coalesce("__pos", F.lit(0)).alias("__pos")).alias("ord"), "source", *cols, "__listed")
    else:
        x = df.select(identifier(c, tag).alias("id"), F.struct(*[F.col(o) for o in order]).alias("ord"), *keep, F.lit(False).alias("__listed"))
    bad = None
    if complete:
        bad, x = x.where("id is null"), x.where("id is not null")
    elif strict and many:
        bad, x = x.where("id is null and __listed"), x.where("id is not null or not __listed")
    if not complete and (ids is None or many or isinstance(_type(df, c), (T.StringType, T.FractionalType)) or any(f.nullable for f in df.select(c.alias("x")).schema)):
        missing = x.where("id is null")
        if not missing.isEmpty():
            numbered = dense_index(missing, ["ord"], "__n").withColumn("id", F.concat(F.lit(tag), F.col("__n").cast("string"))).drop("__n")
            x = x.where("id is not null").unionByName(numbered)
    return x.drop("__listed"), bad


def _bad_ids(bad: DataFrame | None, kind: str) -> list[DataFrame]:
    return [] if bad is None else [bad.select(*_error(kind, ErrorType.BAD_ID, F.lit(f"{'An edge' if kind == 'edge' else 'A node'} was generated that has an invalid ID"), F.array("source")))]


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _error(kind: str, error: ErrorType, message: Column, source: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), F.lit(error.name).alias("error"), F.col("id").alias("entity_id"), message.alias("message"), source.alias("source")]


def _last_wins(x: DataFrame, payload: list[str], kind: str, error: ErrorType) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Last row of each id, and an error for every later occurrence with (row, previous row).

    The rows themselves come from an aggregation with partial results; only ids with several rows go through a window.
    """
    kept = x.groupBy("id").agg(F.max_by(F.struct(*payload), "ord").alias("b"), F.max("ord").alias("ord"), F.count(F.lit(1)).alias("__n"))

    def errors() -> DataFrame:
        many = kept.where("__n > 1").select(F.col("id").alias("__id"))
        w = Window.partitionBy("id").orderBy("ord")
        again = x.select("id", "ord", "source").join(many, F.col("id") == F.col("__id"), "left_semi").withColumn("before", F.lag("source").over(w)).where("before is not null")
        message = F.format_string(f"Duplicate {kind} id: %s", "id")
        return again.select(*_error(kind, error, message, F.array("source", "before")))

    return kept.select("id", "b.*", "ord"), errors


def _merged_meta(x: DataFrame) -> list[Column]:
    """Shallow merge of structs in order: per field the last value that is there; null is absent. Other types: the last value."""
    meta = x.schema["meta"].dataType
    if isinstance(meta, T.StructType):
        fields = [F.max_by(F.col("meta")[f.name], F.when(F.col("meta")[f.name].isNotNull(), F.col("ord"))).alias(f.name) for f in meta.fields]
        return [F.struct(*fields).alias("meta")]
    if isinstance(meta, T.MapType):
        return []
    return [F.max_by("meta", F.when(F.col("meta").isNotNull(), F.col("ord"))).alias("meta")]


def _with_map_meta(out: DataFrame, x: DataFrame) -> DataFrame:
    """out with `meta`, if it is a map: per key of an id's maps the last value that is there, from partial results a key."""
    if not isinstance(x.schema["meta"].dataType, T.MapType):
        return out
    last = x.select("id", "ord", F.explode("meta").alias("k", "v")).where("v is not null").groupBy("id", "k").agg(F.max_by("v", "ord").alias("v"))
    maps = last.groupBy(F.col("id").alias("__id")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))
    return out.join(maps, F.col("id") == F.col("__id"), "left").drop("__id")


def make_network(
    node_data: DataFrame,
    edge_data: DataFrame,
    *,
    node_id: Accessor | None,
    edge_a: Accessor,
    edge_b: Accessor,
    edge_id: Accessor | None = None,
    node_values: Accessor | None = None,
    node_meta: Accessor | None = None,
    edge_values: tuple[Accessor, Accessor] | None = None,
    edge_meta: Accessor | None = None,
    node_order: list[str],
    edge_order: list[str],
    aggregate_results: bool = False,
    aggregate_value_mode: ValueMode = ValueMode.NONE,
    suppress_errors: Iterable[ErrorType] = (),
    delete_while_processing: bool = False,
    ids_complete: bool = False,
) -> NetworkResult:
    """Build a network. Errors are always a DataFrame, maybe empty; suppressing some never changes the network.

    edge_values is the pair (a to b, b to a); if either of an edge's is missing, both are no value. delete_while_processing
    is accepted and does nothing: Spark never holds the source. If node and edge rows have ids of different kinds (numbers
    and strings), ids are tagged with their kind, so that 1 and "1" differ. A null end of an edge is an unknown node.
    ids_complete says that no row lacks its id: rows are then not searched for missing ids, and one without is a BAD_ID error.
    With aggregate_results, a missing entry of an edge's list of ids is one as well. Endpoints are looked up by outer joins,
    where an end that most edges share is split by adaptive execution (spark.sql.adaptive.skewJoin).
    """
    del delete_while_processing
    kinds = {_kind(_type(d, access(d, a))) for d, a in ((node_data, node_id), (edge_data, edge_a), (edge_data, edge_b)) if a is not None}
    tagged = lambda d, a: f"{_kind(_type(d, access(d, a)))}:" if len(kinds) > 1 and a is not None else ("n:" if len(kinds) > 1 else "")
    nodes, node_errors = _nodes(node_data, node_id, node_values, node_meta, node_order, aggregate_results, aggregate_value_mode, tagged(node_data, node_id), ids_complete)
    ends = [identifier(access(edge_data, a), tagged(edge_data, a)) for a in (edge_a, edge_b)]
    edges, edge_errors = _edges(edge_data, nodes, ends, edge_id, edge_values, edge_meta, edge_order, aggregate_results, aggregate_value_mode, ids_complete)
    names = [e.name for e in suppress_errors]

    def errors() -> DataFrame:
        x = edge_errors() if node_errors is None else node_errors().unionByName(edge_errors())
        return x.where(~F.col("error").isin(names)) if names else x

    return NetworkResult(Network(nodes, edges), errors)


def _nodes(df, ids, values, meta, order, aggregate, mode, tag, complete):
    v = access(df, values)
    kind = _type(df, v) if values is not None else T.ArrayType(T.DoubleType())
    value = W.as_list(v, kind) if values is not None else F.lit(None).cast("array<double>")
    x, bad = _rows(df, ids, order, {"value": value, "value_is_scalar": F.lit(W.is_scalar(kind)), "meta": access(df, meta)}, tag, complete)
    none = F.expr(W.NO_VALUE)
    if not aggregate:
        kept, again = _last_wins(x, ["value", "value_is_scalar", "meta"], "node", ErrorType.DUPLICATE_NODE_ID)
        return kept.select("id", F.coalesce("value", none).alias("value"), (F.col("value_is_scalar") & F.col("value").isNotNull()).alias("value_is_scalar"), "meta", "ord"), lambda: _all([again(), *_bad_ids(bad, "node")])
    out = W.merged(x, mode, [("value", "value_is_scalar")] if values is not None else [], [*_merged_meta(x), F.min("ord").alias("ord")])
    out = _with_map_meta(out, x)
    if values is None:
        out = out.withColumns({"value": none, "value_is_scalar": F.lit(False)})
    return out.select("id", F.coalesce("value", none).alias("value"), F.coalesce("value_is_scalar", F.lit(False)).alias("value_is_scalar"), "meta", "ord"), (lambda: _all(_bad_ids(bad, "node"))) if bad is not None else None


def _found(x: DataFrame, nodes: DataFrame) -> DataFrame:
    """x (src, dst) with a_found, b_found: is each end a node? Ids of nodes are unique, so two outer joins do."""
    a = nodes.select(F.col("id").alias("__a"))
    b = nodes.select(F.col("id").alias("__b"))
    x = x.join(a, F.col("src") == F.col("__a"), "left").join(b, F.col("dst") == F.col("__b"), "left")
    return x.withColumn("a_found", F.col("__a").isNotNull()).withColumn("b_found", F.col("__b").isNotNull()).drop("__a", "__b")


def _not_found() -> Column:
    none = ~F.col("a_found") & ~F.col("b_found")
    return F.when(none, "Could not find either node for this edge").when(~F.col("a_found"), "Could not find node a for this edge").otherwise("Could not find node b for this edge")


def _edges(df, nodes, ends, ids, values, meta, order, aggregate, mode, complete):
    both = [access(df, a) for a in values] if values else []
    kind = _type(df, both[0]) if values else T.ArrayType(T.DoubleType())
    ab, ba = (W.as_list(c, _type(df, c)) for c in both) if values else (F.lit(None).cast("array<double>"),) * 2
    there = ab.isNotNull() & ba.isNotNull()
    scalar = F.lit(W.is_scalar(kind))
    cols = {"src": ends[0], "dst": ends[1], "atob": F.when(there, ab), "atob_is_scalar": scalar, "btoa": F.when(there, ba), "btoa_is_scalar": scalar, "meta": access(df, meta)}
    x, bad = _rows(df, ids, order, cols, "", complete, strict=aggregate)
    none = F.expr(W.NO_VALUE)
    value = [F.coalesce(c, none).alias(c) if s is None else (F.coalesce(s, F.lit(False)) & F.col(c).isNotNull()).alias(f"{c}_is_scalar") for c in ("atob", "btoa") for s in (None, F.col(f"{c}_is_scalar"))]
    if not aggregate:
        x = _found(x, nodes)
        valid = x.where("a_found and b_found")
        kept, again = _last_wins(valid, ["src", "dst", "atob", "atob_is_scalar", "btoa", "btoa_is_scalar", "meta"], "edge", ErrorType.DUPLICATE_EDGE_ID)


        def errors() -> DataFrame:
            orphan = x.where("not (a_found and b_found)").select(*_error("edge", ErrorType.NODE_NOT_FOUND, _not_found(), F.array("source")))
            return _all([orphan, again(), *_bad_ids(bad, "edge")])

        return kept.select("id", "src", "dst", *value, "meta", "ord"), errors
    x = _found(x, nodes)
    last = lambda c, found: F.max_by(c, F.when(F.col(found), F.col("ord"))).alias(c)
    ends_of = [last("src", "a_found"), last("dst", "b_found"), F.max("a_found").alias("a_found"), F.max("b_found").alias("b_found")]
    channels = [(c, f"{c}_is_scalar") for c in ("atob", "btoa")] if values else []
    base = W.merged(x, mode, channels, [*ends_of, *_merged_meta(x), F.min("ord").alias("ord")])

    def errors() -> DataFrame:
        gone = x.groupBy("id").agg(F.max("a_found").alias("a_found"), F.max("b_found").alias("b_found")).where("not (a_found and b_found)")
        rows_of_bad = x.join(gone.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "source"))).alias("rows"))
        found = gone.join(rows_of_bad.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"))
        return _all([found.select(*_error("edge", ErrorType.NODE_NOT_FOUND, _not_found(), F.transform("rows", lambda r: r["source"]))), *_bad_ids(bad, "edge")])

    out = _with_map_meta(base.where("a_found and b_found"), x)
    if not values:
        out = out.withColumns({c: none for c in ("atob", "btoa")} | {f"{c}_is_scalar": F.lit(False) for c in ("atob", "btoa")})
    return out.select("id", "src", "dst", *value, "meta", "ord"), errors
