"""Rows of a provider as a stream: a network kept in files that grows batch by batch, exactly once.

A batch's nodes and edges are added to those that the store holds (first of an id wins, known ids are no error on a
replay). Each batch writes folders named by its number, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

NODE = "id string, value array<double>, value_is_scalar boolean"
EDGE = "id string, src string, dst string, atob array<double>, atob_is_scalar boolean, btoa array<double>, btoa_is_scalar boolean"


class NetworkStore:
    """nodes/batch=N and edges/batch=N below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, kind: str, before: int | None = None) -> DataFrame:
        """All rows of a kind, or those of batches before one (the folders of others aren't read)."""
        schema = NODE if kind == "nodes" else EDGE
        try:
            x = self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{kind}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        return x if before is None else x.where(F.col("batch") < before)

    def add(self, kind: str, rows: DataFrame, batch: int) -> None:
        """Add the rows with new ids, one of each id (the smallest row, as structs compare)."""
        cols = [c for c in rows.columns if c != "id"]
        new = rows.where("id is not null").groupBy("id").agg(F.min(F.struct(*cols)).alias("b")).select("id", "b.*")
        known = self.table(kind, before=batch).select(F.col("id").alias("__id"))
        new = new.join(known, F.col("id") == F.col("__id"), "left_anti")
        new.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")


def ingest(rows: DataFrame, store: NetworkStore, to_nodes, to_edges, checkpoint: str, at: str | None = None, late: str = "7 days") -> StreamingQuery:
    """Run a stream of provider rows into the store until it has what is there now.

    to_nodes and to_edges make node and edge rows (see NODE, EDGE) of a batch; either can be None. With `at`, rows of an id
    that were sent again within `late` of event time `at` are dropped before.
    """
    x = rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["id"]) if at else rows

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        for kind, make in (("nodes", to_nodes), ("edges", to_edges)):
            if make is not None:
                store.add(kind, make(df), number)
        df.unpersist()

    return x.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
