"""Weights: a number or a list of numbers, and how several of them combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.model import ValueMode

NO_VALUE = "cast(array() as array<double>)"


def as_list(c: Column, kind: T.DataType) -> Column:
    """The weights in column c of type `kind` as a list; null if missing (null, or NaN as a number)."""
    if isinstance(kind, T.ArrayType):
        return c.cast("array<double>")
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), F.array(d))


def is_scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, T.ArrayType)


def merged(rows: DataFrame, mode: ValueMode, channels: list[tuple[str, str]], aggs: list[Column]) -> DataFrame:
    """(id, aggs..., value, scalar of each channel): rows (id, ord, ...) of an id combined in order of ord, in one pass (OVERRIDE: two).

    aggs are aggregations of the rows by id. A channel is a pair (value, scalar); rows whose value is null or an empty list
    don't take part in it: what is missing never overwrites, and a channel without any value is null.

    NONE: the last value. OVERRIDE: a number replaces all before it and is replaced by a list after it; a list overrides
    slot by slot where it isn't null. CONCAT: all values one after another, nulls stripped, always a list when several
    rows contribute. NONE and OVERRIDE keep partial results only, whatever the size of a group: OVERRIDE groups by slot
    before it groups by id. The result of CONCAT has every value of an id by definition.
    """
    if mode == ValueMode.OVERRIDE and channels:
        return _overridden(rows, channels, aggs)
    out, cols = list(aggs), []
    for value, scalar in channels:
        there = F.size(value) > 0
        if mode == ValueMode.CONCAT:
            every = F.array_sort(F.collect_list(F.when(there, F.struct(F.col("ord").alias("o"), F.col(value).alias("v")))))
            one = F.count(F.when(there, F.lit(1)))
            out.append(F.struct(F.filter(F.flatten(F.transform(every, lambda r: r["v"])), lambda w: w.isNotNull()).alias("v"), ((one == 1) & F.first(F.when(there, F.col(scalar)), True)).alias("s"), one.alias("n")).alias(f"__{value}"))
            cols += [F.when(F.col(f"__{value}.n") > 0, F.col(f"__{value}.v")).alias(value), F.when(F.col(f"__{value}.n") > 0, F.col(f"__{value}.s")).alias(scalar)]
        else:
            out.append(F.max_by(F.struct(F.col(value).alias("v"), F.col(scalar).alias("s")), F.when(there, F.col("ord"))).alias(f"__{value}"))
            cols += [F.col(f"__{value}.v").alias(value), F.col(f"__{value}.s").alias(scalar)]
    x = rows.groupBy("id").agg(*out)
    return x.select(*[c for c in x.columns if c not in {f"__{v}" for v, _ in channels}], *cols)


def _overridden(rows: DataFrame, channels: list[tuple[str, str]], aggs: list[Column]) -> DataFrame:
    """One narrow row a slot of all channels' lists (a number is slot -1): the last list that reaches a slot and the last
    number in it are combined by slot, then the slots by id, and join the aggregations of the rows themselves."""
    slot = lambda k, pos, w: F.struct(F.lit(k).alias("c"), pos.alias("pos"), w.alias("w"))
    none = F.expr("cast(array() as array<struct<c:int,pos:int,w:double>>)")

    def slots(k: int, v: str, s: str) -> Column:
        return F.coalesce(F.transform(v, lambda w, i: slot(k, F.when(F.col(s), F.lit(-1)).otherwise(i.cast("int")), w)), none)

    lists = [slots(k, v, s) for k, (v, s) in enumerate(channels)]
    x = rows.select("id", "ord", F.inline(F.concat(*lists)))
    w = F.col("w")
    first = x.groupBy("id", "c", "pos").agg(F.max("ord").alias("reached"), F.max_by(F.struct("ord", "w"), F.when(w.isNotNull(), F.col("ord"))).alias("w"))
    of = lambda k, c: F.when(F.col("c") == k, c)
    per = []
    for k, (v, _) in enumerate(channels):
        per += [F.array_sort(F.collect_list(of(k, F.struct("pos", "reached", "w")))).alias(f"__a{k}")]
        per += [F.max(of(k, F.when(F.col("pos") < 0, F.col("reached")))).alias(f"__n{k}"), F.max(of(k, F.when(F.col("pos") >= 0, F.col("reached")))).alias(f"__l{k}")]
    out = first.groupBy("id").agg(*per)
    cols = []
    for k, (v, s) in enumerate(channels):
        number_at, list_at = F.col(f"__n{k}"), F.col(f"__l{k}")
        after = lambda o, n=number_at: n.isNull() | (o > n)
        taken = F.transform(F.filter(f"__a{k}", lambda r: (r["pos"] >= 0) & after(r["reached"])), lambda r: F.when(after(r["w"]["ord"]), r["w"]["w"]))
        number = F.transform(F.filter(f"__a{k}", lambda r: r["pos"] < 0), lambda r: r["w"]["w"])
        scalar = F.coalesce(number_at > list_at, number_at.isNotNull())
        there = number_at.isNotNull() | list_at.isNotNull()
        cols += [F.when(there, F.when(scalar, number).otherwise(taken)).alias(v), F.when(there, scalar).alias(s)]
    out = out.select("id", *cols)
    if not aggs:
        return out
    base = rows.groupBy("id").agg(*aggs)
    return base.join(out.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").drop("__id")


def combine(rows: DataFrame, mode: ValueMode, value: str, scalar: str) -> DataFrame:
    """(id, value, scalar) of each id in rows (id, ord, value, scalar) that has any value; see merged()."""
    return merged(rows, mode, [(value, scalar)], []).where(F.col(value).isNotNull())
