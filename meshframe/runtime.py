"""What every operator needs from the session: tables, lineage cuts, checked broadcasts, hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

#: Rows up to which a table counts as small enough to broadcast, once it is measured.
BROADCAST_ROWS = 200_000
#: Bytes, as text, up to which it does.
BROADCAST_BYTES = 64 << 20


_schemas: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; its schema is looked up once an application."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; only where none is named and all runs on this machine (tests), a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="meshframe-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def new_path(spark: SparkSession) -> str:
    """A place for a table in the shared checkpoint folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame, flag: Column | None = None, also: Column | None = None) -> DataFrame:
    """Cut the lineage: df is written as a table to the shared checkpoint folder and read from there.

    A written table carries no constraints or statistics of the plan that made it, which grow with every round of a loop
    where checkpoint() hands them on; and it is columnar, compressed and of known size. The rows are counted as they are
    written: `n_rows` of the result is their number, `n_flagged` that of the rows where `flag` is true, `also` the aggregate asked for.
    """
    spark = df.sparkSession
    path = new_path(spark)
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.lit(False) if flag is None else flag).alias("n_flagged"), (F.count(F.lit(1)) if also is None else also).alias("also")]
    df.observe(seen, *counts).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to, out.n_rows, out.n_flagged, out.also = path, seen.get["n_rows"], seen.get["n_flagged"], seen.get["also"]
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later step reads."""
    for t in tables:
        delete(t.sparkSession, t.written_to)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `rows` rows, which take at most `size` bytes as text; reads no more rows than it needs to tell."""
    got = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return got[0] <= rows and got[1] <= size


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is found to be small, else df as it is (a shuffled join)."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def hot_values(df: DataFrame, key: str, rows: int) -> list:
    """Values of `key` that hold more than a quarter of an even task's share of the `rows` rows.

    At most 4 x shuffle partitions values can qualify, so the list has a fixed bound. The counting combines before its
    shuffle, so a hot value costs nothing there.
    """
    least = max(rows // (4 * parts(df.sparkSession)), 50_000)
    if rows <= least:
        return []
    return [r[0] for r in df.groupBy(key).count().where(F.col("count") > least).select(key).collect() if r[0] is not None]


def lookup(facts: DataFrame, key: str, dim: DataFrame, dim_key: str, value: str, out: str, rows: int, how: str = "inner") -> DataFrame:
    """facts with column `out` = dim.value where dim.dim_key = facts.key; dim_key is unique in dim.

    Rows of hot keys don't meet in one task: their few dim rows (bounded, see hot_values) are broadcast to them.
    """
    d = dim.select(F.col(dim_key).alias("__k"), F.col(value).alias(out))
    hot = hot_values(facts, key, rows)
    join = lambda f, x: f.join(x, f[key] == x["__k"], how).drop("__k")
    if not hot:
        return join(facts, d)
    few = F.broadcast(facts.sparkSession.createDataFrame([(h,) for h in hot], T.StructType([T.StructField("__h", facts.schema[key].dataType)])))
    of = lambda x, c, kind: x.join(few, x[c] == few["__h"], kind)
    return join(of(facts, key, "left_anti"), d).unionByName(join(of(facts, key, "left_semi"), F.broadcast(of(d, "__k", "left_semi"))))
