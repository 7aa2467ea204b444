"""Positions without a single task: contiguous numbers over a declared order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe import runtime


def dense_index(df: DataFrame, order: list, name: str, cut: Callable[[DataFrame], DataFrame] = runtime.cut) -> DataFrame:
    """df with a bigint column `name`: 0, 1, 2, ... in the order of `order` (which should be total).

    The rows are range-partitioned and sorted, numbered within their partitions, and shifted by the sizes of the
    partitions before: one row a partition is all that meets in one task. `cut` writes the rows.
    """
    x = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = x.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    out = x.join(F.broadcast(sizes), part == F.col("__part"))  # one row a partition
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")
