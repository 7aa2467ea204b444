"""Per-key results where a few keys hold most rows: value-frequency compression.

Rows are grouped by (key, value) before they are grouped by key. The first grouping spreads a hot key over all tasks by
its values and combines on the map side, so equal rows never travel; the second one sees one row a distinct value, and
partial results of it travel only. Counts, sums, distinct counts, modes and percentiles are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.runtime import cut

#: Distinct values of a key that a task sorts, and the parts into which a slice with more of them is divided.
SORTED, WAYS = 1_000_000, 1024


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a distinct (keys, value) with its number of rows, `n`. Null values form a value of their own."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per keys: n_rows, n_values (distinct, null and NaN aside), value_sum (null and NaN aside; null if none), mode_value.

    Null keys are dropped; an empty df gives no rows. Ties of the mode go to the smallest value. `value` is numeric.
    """
    v = F.col(value).cast("double")
    there = v.isNotNull() & ~F.isnan(v)
    w = compress(df.dropna(subset=keys), keys, value)
    return w.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.when(there, F.lit(1))).alias("n_values"),
        F.sum(F.when(there, v * F.col("n"))).alias("value_sum"),
        F.max_by(F.when(there, v), F.when(there, F.struct(F.col("n"), -v))).alias("mode_value"),
    )


def heavy(profiled: DataFrame, field: str, key: str, share: float) -> DataFrame:
    """Keys that hold at least `share` of the rows of their field. The totals have one row a field."""
    total = profiled.groupBy(F.col(field).alias("__f")).agg(F.sum("n_rows").alias("__total"))
    p = profiled.alias("p").join(F.broadcast(total), F.col(f"p.{field}") == F.col("__f"))  # as many rows as fields
    return p.where(F.col("n_rows") >= F.col("__total") * F.lit(share)).select(field, key, "n_rows")


def _slice_of_rank(w: DataFrame, keys: list[str]) -> DataFrame:
    """w (keys, __at, n, __rank) -> the slice `__at` of each key that holds its wanted rank: (keys, __at, __rank in it, __size distinct values)."""
    run = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    slices = w.groupBy(*keys, "__at").agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__size"), F.max("__rank").alias("__rank"))
    slices = slices.withColumn("__upto", F.sum("__n").over(run)).where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__n") < F.col("__rank")))
    return slices.select(*keys, "__at", (F.col("__rank") - (F.col("__upto") - F.col("__n"))).alias("__rank"), "__size")


def percentile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Exact discrete percentile (smallest value whose cumulated share reaches q) per keys, as `percentile`.

    Null and NaN values and null keys are left out. A radix selection over compressed values: they are counted by slices of
    their magnitude (an eighth of an octave), and only the slice that holds the wanted rank is kept; while any key's slice has
    more than SORTED distinct values, it is counted by WAYS equal parts of its range and narrowed again (at most six times,
    as an octave has 52 bits). What is left of a key is sorted in a task.
    """
    v = F.col(value).cast("double")
    w = compress(df.where(v.isNotNull() & ~F.isnan(v)).dropna(subset=keys).withColumn(value, v + F.lit(0.0)), keys, value)
    size, sign = F.abs(F.col(value)), F.signum(value)
    octave = F.when(size == 0, F.lit(0.0)).when(size == float("inf"), sign * 30_000).otherwise(sign * (F.floor(F.log2(size) * 8) + 10_000))
    total = F.sum("n").over(Window.partitionBy(*keys))
    w = w.withColumn("__at", octave.cast("int"))
    slices = w.groupBy(*keys, "__at").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("__size"))  # the first ranks need totals by key
    slices = slices.withColumn("__rank", F.greatest(F.ceil(total * F.lit(q)), F.lit(1)))
    run = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("__upto", F.sum("n").over(run)).where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("n") < F.col("__rank")))
    slices = slices.select(*keys, "__at", (F.col("__rank") - (F.col("__upto") - F.col("n"))).alias("__rank"), "__size")
    slices = cut(slices, F.col("__size") > SORTED)
    hit = w.join(slices.drop("__size"), [*keys, "__at"])
    while slices.n_flagged:
        x = cut(hit.drop("__at"))
        ends = x.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(F.lit(1)).alias("__m"))
        part = F.least(F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * WAYS), F.lit(WAYS - 1))
        x = x.join(ends, keys).withColumn("__at", F.when(F.col("__m") > SORTED, part).otherwise(0).cast("int")).drop("__lo", "__hi", "__m")
        slices = cut(_slice_of_rank(x, keys), F.col("__size") > SORTED)
        hit = x.drop("__rank").join(slices.drop("__size"), [*keys, "__at"])
    inner = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("__upto", F.sum("n").over(inner))
    return hit.where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("n") < F.col("__rank"))).select(*keys, F.col(value).alias("percentile"))
