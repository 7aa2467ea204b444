"""Queries of the general training-data problems: hot keys (p3) and references to records that do not exist (p5)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.functions.presence import canonical_uid
from meshframe.operators import orphans, skew
from meshframe.runtime import read

HEAVY_SHARE = 0.01
BATCHES = 4


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """(field, node_id, value): the far-end ids of iedge.a, inode.in_ids and inode.out_ids.

    The value is the first atob weight of the edge, or the id of the listing node.
    """
    edges = read(spark, d, "iedge").select(F.lit("a").alias("field"), F.col("a").alias("node_id"), F.get("atob", F.lit(0)).alias("value"))
    lists = read(spark, d, "inode").select(F.col("id").cast("double").alias("value"), F.inline(F.array(F.struct(F.lit("in").alias("field"), F.col("in_ids").alias("ids")), F.struct(F.lit("out").alias("field"), F.col("out_ids").alias("ids")))))
    lists = lists.select("field", F.explode("ids").alias("node_id"), "value")
    return edges.unionByName(lists)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = skew.heavy(skew.profile(_fields(spark, d), ["field", "node_id"], "value"), "field", "node_id", HEAVY_SHARE)
    return found.select("field", "node_id")


def p3_edges(spark: SparkSession, d: str) -> DataFrame:
    """Per node id the edges leaving it: their number, the sum of their first weights, distinct weights and the mode."""
    edges = read(spark, d, "iedge").select("a", F.get("atob", F.lit(0)).alias("w"))
    x = skew.profile(edges, ["a"], "w")
    return x.select(F.col("a").alias("node_id"), F.col("n_rows").alias("n_edges"), F.round("value_sum", 3).alias("weight_sum"), F.col("n_values").alias("n_weights"), F.col("mode_value").alias("mode_weight"))


def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    """Per node id the number of its entries in in_ids and out_ids, and of the nodes that list it."""
    lists = _fields(spark, d).where("field <> 'a'")
    x = skew.profile(lists, ["field", "node_id"], "value")
    return x.select("field", "node_id", F.col("n_rows").alias("n_entries"), F.col("n_values").alias("n_listing"))


def p3_median(spark: SparkSession, d: str) -> DataFrame:
    """Per node id the exact lower median of the first weights of the edges leaving it."""
    edges = read(spark, d, "iedge").select(F.col("a").alias("node_id"), F.get("atob", F.lit(0)).alias("w"))
    return skew.percentile(edges, ["node_id"], "w", 0.5).select("node_id", F.col("percentile").alias("median_weight"))


def _replayed(spark: SparkSession, d: str):
    """States of the orphan tracker over the arrivals, in BATCHES batches of equal time."""
    node, edge, anchor = (read(spark, d, t) for t in ("test_node", "test_edge", "anchor_node"))
    always = anchor.select(canonical_uid(F.col("uid")).alias("key"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(1).cast("bigint").alias("opened"), F.lit(1).cast("bigint").alias("seen"), F.lit(None).cast("timestamp_ntz").alias("known")).where("key is not null")
    events = orphans.parent_events(node, canonical_uid(F.col("uid")), "arrived_at", "removed_at").unionByName(always)
    sides = F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("uid_a").alias("uid")), F.struct(F.lit("b").alias("side"), F.col("uid_b").alias("uid"))))
    refs = edge.select(F.col("row_id").alias("ref"), F.col("date_metric").alias("at"), F.col("arrived_at").alias("known"), sides)
    refs = refs.select(canonical_uid(F.col("uid")).alias("key"), "at", "ref", "side", "known").where("key is not null")
    first, last = edge.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    bounds = [] if first is None or first == last else [(first + (last - first) / BATCHES * k).replace(microsecond=0) + timedelta(seconds=1) for k in range(1, BATCHES)]
    return orphans.replay(events, refs, bounds)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    *_, (_, last) = _replayed(spark, d)
    return last.orphans().select(F.col("ref").alias("edge_row"), "side")


def _month() -> Column:
    return F.date_format("at", "yyyy-MM").alias("month")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referring table, side and month of the reference."""
    *_, (_, last) = _replayed(spark, d)
    return last.counts(_month()).select(F.lit("test_edge").alias("referring"), "side", "month", "n_orphans")


def p5_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The same counts after each batch, as pending at that time; the last has no time."""
    states = list(_replayed(spark, d))
    taken = spark.createDataFrame([(s.batch, at.isoformat(sep=" ") if at else None) for at, s in states], "batch int, taken_at string")
    x = states[-1][1].snapshots(_month()).join(F.broadcast(taken), "batch")  # one row a batch
    return x.select(F.lit("test_edge").alias("referring"), "side", "month", "n_orphans", "taken_at")


QUERIES = {f.__name__: f for f in (p3_found, p3_edges, p3_entries, p3_median, p5_found, p5_counts, p5_snapshots)}

_ENTRIES = """
  select 'a' as field, a as node_id, cast(null as bigint) as listing from iedge where a is not null
  union all select * from (select 'in' as field, unnest(in_ids) as node_id, id as listing from inode) where node_id is not null
  union all select * from (select 'out' as field, unnest(out_ids) as node_id, id as listing from inode) where node_id is not null
"""

_REFS = r"""
  select row_id as edge_row, side, nullif(lower(regexp_replace(uid, '[^A-Za-z0-9]', '', 'g')), '') as key, date_metric as d, arrived_at
  from (select row_id, 'a' as side, uid_a as uid, date_metric, arrived_at from test_edge
        union all select row_id, 'b' as side, uid_b as uid, date_metric, arrived_at from test_edge)
"""

_PARENTS = r"""
  select lower(regexp_replace(uid, '[^A-Za-z0-9]', '', 'g')) as key, arrived_at as b, removed_at as e, false as always from test_node
  union all select lower(regexp_replace(uid, '[^A-Za-z0-9]', '', 'g')) as key, null, null, true from anchor_node
"""

_ORPHANS = f"""
  select r.edge_row, r.side, r.d from ({_REFS}) r where r.key is not null
  and not exists (select 1 from ({_PARENTS}) p where p.key = r.key
                  and (p.always or r.d is null or (p.b <= r.d and (p.e is null or p.e > r.d))))
"""

_BOUNDS = f"""
  select date_trunc('second', mn + (mx - mn) / {BATCHES} * k) + interval 1 second as t
  from (select min(arrived_at) as mn, max(arrived_at) as mx from test_edge), (select unnest(range(1, {BATCHES})) as k)
  union all select null
"""

SQL = {
    "p3_found": f"""
with e as ({_ENTRIES}), n as (select field, node_id, count(*) as c from e group by 1, 2)
select field, node_id from (select *, sum(c) over (partition by field) as total from n) where c >= 0.01 * total""",
    "p3_edges": """
with e as (select a as node_id, atob[1] as w from iedge where a is not null),
     v as (select node_id, w, count(*) as n from e where w is not null and not isnan(w) group by 1, 2),
     m as (select node_id, w from v qualify row_number() over (partition by node_id order by n desc, w) = 1),
     s as (select node_id, count(*) as k, sum(w * n) as total from v group by 1)
select c.node_id, c.n_edges, round(s.total, 3) as weight_sum, coalesce(s.k, 0) as n_weights, m.w as mode_weight
from (select node_id, count(*) as n_edges from e group by 1) c left join s using (node_id) left join m using (node_id)""",
    "p3_entries": f"""
select field, node_id, count(*) as n_entries, count(distinct listing) as n_listing from ({_ENTRIES}) where field <> 'a' group by 1, 2""",
    "p3_median": """
select node_id, quantile_disc(w, 0.5) as median_weight from (select a as node_id, atob[1] as w from iedge)
where node_id is not null and w is not null and not isnan(w) group by 1""",
    "p5_found": f"select edge_row, side from ({_ORPHANS})",
    "p5_counts": f"""
select 'test_edge' as referring, side, strftime(d, '%Y-%m') as month, count(*) as n_orphans from ({_ORPHANS}) group by all""",
    "p5_snapshots": f"""
with t as ({_BOUNDS}), r as ({_REFS}), p as ({_PARENTS}), x as (
  select t.t, r.edge_row, r.side, r.d from t, r where r.key is not null and (t.t is null or r.arrived_at is null or r.arrived_at <= t.t)
  and not exists (select 1 from p where p.key = r.key and (t.t is null or p.b is null or p.b <= t.t)
    and (p.always or r.d is null or (p.b <= r.d and (p.e is null or p.e > r.d or p.e > t.t)))))
select 'test_edge' as referring, side, strftime(d, '%Y-%m') as month, count(*) as n_orphans, strftime(t, '%Y-%m-%d %H:%M:%S') as taken_at from x group by side, month, taken_at""",
}
