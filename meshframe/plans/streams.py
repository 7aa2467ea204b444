"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.runtime import new_path, read
from meshframe.streaming.ingest import NetworkStore, ingest


def st_ingest(s: SparkSession, d: str) -> DataFrame:
    """match_edge as a stream into a network: nodes of both ends and the edges; the ids that are then there."""
    at = new_path(s)
    store = NetworkStore(s, f"{at}/store")
    none = F.expr("cast(array() as array<double>)")
    text = lambda c: F.col(c).cast("string")

    def nodes(x: DataFrame) -> DataFrame:
        return x.select(F.explode(F.array(text("a"), text("b"))).alias("id"), none.alias("value"), F.lit(False).alias("value_is_scalar"))

    def edges(x: DataFrame) -> DataFrame:
        whole = x.where("a is not null and b is not null")
        return whole.select(text("id").alias("id"), text("a").alias("src"), text("b").alias("dst"), F.coalesce("atob", none).alias("atob"), F.lit(False).alias("atob_is_scalar"), F.coalesce("btoa", none).alias("btoa"), F.lit(False).alias("btoa_is_scalar"))

    source = s.readStream.schema(read(s, d, "match_edge").schema).parquet(f"{d}/match_edge.parquet*")
    ingest(source, store, nodes, edges, f"{at}/progress").awaitTermination()
    return store.table("nodes").select(F.lit("node").alias("kind"), "id").unionByName(store.table("edges").select(F.lit("edge").alias("kind"), "id"))


QUERIES = {"st_ingest": st_ingest}
SQL = {
    "st_ingest": """select 'node' as kind, cast(x as varchar) as id from (select a as x from match_edge union select b from match_edge) where x is not null
union all select 'edge', cast(id as varchar) from match_edge where a is not null and b is not null"""
}
