"""References to records that do not exist: keyed pending-orphan state, maintained incrementally.

State: the parent index (per key and instant the net number of parents opened there and the number of parent rows ever
seen) and the references with their status, both as logs: every batch appends a folder of what it changes, split into
buckets of keys. Nothing that a batch doesn't touch is read or written again. A batch brings parents, removals and references:

* new references probe the parent index at their own date;
* arriving parents resolve waiting orphans of their key, removals reopen references of theirs. An event at an instant
  changes what is open from then on only, so of the touched keys only references dated at or after their earliest event
  are looked at again, and undated orphans where a parent is seen. Buckets of other keys aren't read, and files whose
  dates are all earlier are skipped by their statistics;
* a status change is a row with the orphans it adds or takes away; the counts of pending orphans after each batch are
  sums of these rows.

Probing is a running sum over each key's time line. The line is cut into slices of `SLICE_DAYS`; what is open at the
start of a slice is carried into it, so that the slices of one key are separate tasks and a key that holds a third of all
references is spread over all its slices. References without a date have slices of their own, salted. Where the touched
keys are too many to be broadcast, references meet them by key and salt, so a hot key is no single task there either.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshframe.runtime import BROADCAST_ROWS, cut, delete, drop, new_path, parts

SLICE_DAYS = 7
#: Slices of the references without a date, and of parents without a beginning.
UNDATED, ALWAYS, SALTS = 1_000_000, -1_000_000, 64
#: Parts of a key's references where many touched keys meet them.
SPLIT = 8
INDEX = "key string, at timestamp_ntz, opened bigint, seen bigint, batch int, bucket int"
REFS = "key string, at timestamp_ntz, ref bigint, side string, n bigint, change bigint, batch int, bucket int"


@dataclass(frozen=True)
class OrphanState:
    """The logs index/ and refs/ below `path` up to a batch: batch=B/bucket=K folders from batch `base` on."""

    spark: SparkSession
    path: str
    buckets: int
    batch: int = 0
    base: int = 0

    def log(self, kind: str) -> DataFrame:
        """index: (key, at, opened, seen); refs: (key, at, ref, side, n new references, change of their orphans)."""
        x = self.spark.read.schema(INDEX if kind == "index" else REFS).parquet(f"{self.path}/{kind}")
        return x.where(F.col("batch").between(self.base, self.batch))

    def current(self) -> DataFrame:
        """(key, at, ref, side, n, orphans): each reference once, with how often it came and how many of it are orphans: 0 or n."""
        return self.log("refs").groupBy("key", "at", "ref", "side").agg(F.sum("n").alias("n"), F.sum("change").alias("orphans"))

    @property
    def refs(self) -> DataFrame:
        """(key, at, ref, side, orphan), repeated as often as they came."""
        x = self.current().withColumn("__", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
        return x.select("key", "at", "ref", "side", (F.col("orphans") > 0).alias("orphan"))

    def orphans(self) -> DataFrame:
        """(key, at, ref, side) of the pending orphans."""
        x = self.current().where("orphans > 0")
        return x.withColumn("__", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("key", "at", "ref", "side")

    def counts(self, *by: Column) -> DataFrame:
        """Pending orphans by side and `by`, from the changes alone; groups without any are left out."""
        return self.log("refs").where("change <> 0").groupBy("side", *by).agg(F.sum("change").alias("n_orphans")).where("n_orphans > 0")

    def snapshots(self, *by: Column) -> DataFrame:
        """counts() after each batch (batch, side, by..., n_orphans), from one pass over the changes."""
        delta = self.log("refs").where("change <> 0").groupBy("batch", "side", *by).agg(F.sum("change").alias("n"))
        names = [c for c in delta.columns if c not in ("batch", "n")]
        later = delta.withColumn("batch", F.explode(F.sequence(F.col("batch"), F.lit(self.batch))))  # few rows: counts a batch
        return later.groupBy("batch", *names).agg(F.sum("n").alias("n_orphans")).where("n_orphans > 0")

    def append(self, kind: str, rows: DataFrame) -> None:
        """Write the batch's folder; one that a failed run has left is replaced. Buckets become few files, large ones several."""
        x = rows.withColumn("bucket", self.bucket(F.col("key"))).hint("rebalance", F.col("bucket"))
        x.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{kind}/batch={self.batch}")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.hash(key), F.lit(self.buckets)).cast("int")


def _slice(at: Column) -> Column:
    return F.floor(F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) / SLICE_DAYS).cast("int")


def parent_events(parents: DataFrame, key: Column, begin: str, end: str) -> DataFrame:
    """(key, at, opened, seen, known): a parent opens at `begin` and closes at `end`.

    `known` is when the event becomes known. A row with no beginning or an end not after it is never open, but seen.
    """
    b, e = F.col(begin), F.col(end)
    lives = F.coalesce(b.isNotNull() & (e.isNull() | (e > b)), F.lit(False))
    rows = parents.select(key.alias("key"), b.alias("b"), e.alias("e"), lives.alias("lives")).where(F.col("key").isNotNull())
    opens = rows.select("key", F.col("b").alias("at"), F.col("lives").cast("bigint").alias("opened"), F.lit(1).cast("bigint").alias("seen"), F.col("b").alias("known"))
    closes = rows.where("lives and e is not null").select("key", F.col("e").alias("at"), F.lit(-1).cast("bigint").alias("opened"), F.lit(0).cast("bigint").alias("seen"), F.col("e").alias("known"))
    return opens.unionByName(closes)


def probe(refs: DataFrame, index: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """refs (key, at, ref, side, carry...) with `orphan`: nothing is open at `at`, or without a date, nothing was ever seen."""
    x = index.select("key", F.coalesce(_slice(F.col("at")), F.lit(ALWAYS)).alias("slice"), "at", "opened", "seen")
    r = refs.select("key", F.when(F.col("at").isNull(), F.lit(UNDATED) + F.pmod(F.hash("ref"), F.lit(SALTS))).otherwise(_slice(F.col("at"))).alias("slice"), "at", F.struct("ref", "side", *carry).alias("r"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast(r.schema["r"].dataType).alias("r")
    per_slice = x.groupBy("key", "slice").agg(F.sum("opened").alias("opened"), F.sum("seen").alias("seen"), F.lit(False).alias("asked"))
    asked = r.groupBy("key", "slice").agg(zero.alias("opened"), zero.alias("seen"), F.lit(True).alias("asked"))
    before = Window.partitionBy("key").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = per_slice.unionByName(asked).select("key", "slice", "asked", F.sum("opened").over(before).alias("opened"), F.sum("seen").over(before).alias("seen"))
    carried = carried.where("asked").select("key", "slice", F.lit(0).alias("turn"), F.lit(None).cast("timestamp_ntz").alias("at"), F.coalesce("opened", zero).alias("opened"), F.coalesce("seen", zero).alias("seen"), none)
    line = carried.unionByName(x.select("key", "slice", F.lit(1).alias("turn"), F.col("at").cast("timestamp_ntz").alias("at"), "opened", "seen", none))
    line = line.unionByName(r.select("key", "slice", F.lit(2).alias("turn"), F.col("at").cast("timestamp_ntz").alias("at"), zero.alias("opened"), zero.alias("seen"), "r"))
    upto = Window.partitionBy("key", "slice").orderBy(F.col("at").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, 0)
    line = line.select("*", F.sum("opened").over(upto).alias("open_now"), F.sum("seen").over(upto).alias("seen_now")).where("turn = 2")
    return line.select("key", "at", "r.*", F.when(F.col("at").isNull(), F.col("seen_now") == 0).otherwise(F.col("open_now") <= 0).alias("orphan"))


def affected(state: OrphanState, touched: DataFrame) -> DataFrame:
    """(key, at, ref, side, n, was): references of the state that events of touched keys (key, since, seen, bucket) can change.

    `touched` is a written table, `also` its earliest `since`. Only buckets of touched keys are read; their number is fixed.
    """
    buckets = [r[0] for r in touched.select("bucket").distinct().collect()]
    log = state.log("refs").where(F.col("bucket").isin(buckets)).withColumnRenamed("key", "__key").drop("bucket")
    t = touched.select("key", "since", "seen")
    if touched.also is not None:
        log = log.where(F.col("at").isNull() | (F.col("at") >= F.lit(touched.also)))
    else:
        log = log.where(F.col("at").isNull())
    same = F.col("__key") == F.col("key")
    if touched.n_rows <= BROADCAST_ROWS:
        x = log.join(F.broadcast(t), same)
    else:
        log = log.withColumn("__salt", F.pmod(F.xxhash64("ref", "side"), F.lit(SPLIT)))
        t = t.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPLIT - 1).cast("bigint"))))
        x = log.join(t, same & (F.col("__salt") == F.col("__s")))
    x = x.where((F.col("at") >= F.col("since")) | (F.col("at").isNull() & F.col("seen")))
    x = x.groupBy("key", "at", "ref", "side").agg(F.sum("n").alias("n"), F.sum("change").alias("was"))
    return x.where("at is not null or was > 0")


def advance(state: OrphanState | None, events: DataFrame, refs: DataFrame) -> OrphanState:
    """The state after a batch of parent events (key, at, opened, seen) and new references (key, at, ref, side).

    Events and references without a key are dropped; an event without an instant holds always.
    """
    spark = events.sparkSession
    now = OrphanState(spark, new_path(spark), max(8, parts(spark))) if state is None else replace(state, batch=state.batch + 1)
    new = events.where("key is not null").groupBy("key", "at").agg(F.sum("opened").cast("bigint").alias("opened"), F.sum("seen").cast("bigint").alias("seen"))
    now.append("index", new.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "opened", "seen"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    asked = refs.where("key is not null").select("key", F.col("at").cast("timestamp_ntz").alias("at"), "ref", "side", one.alias("n"), zero.alias("was"), one.alias("added"))
    touched = None
    if state is not None:
        since = F.min(F.when(F.col("opened") != 0, F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz"))))
        mine = now.log("index").where(F.col("batch") == now.batch)
        touched = cut(mine.groupBy("key", "bucket").agg(since.alias("since"), (F.sum("seen") > 0).alias("seen")), also=F.min("since"))
        if touched.n_rows:
            asked = affected(state, touched).select("*", zero.alias("added")).unionByName(asked)
    # rows alike are one, with their number; one that came before and comes again as well
    asked = cut(asked.groupBy("key", "at", "ref", "side").agg(F.sum("n").alias("n"), F.sum("was").alias("was"), F.sum("added").alias("added")))
    keys = asked.select(F.col("key").alias("__k")).distinct()
    index = now.log("index").join(keys, F.col("key") == F.col("__k"), "left_semi").groupBy("key", "at").agg(F.sum("opened").alias("opened"), F.sum("seen").alias("seen"))
    found = probe(asked, index, ("n", "was", "added"))
    change = F.when(F.col("orphan"), F.col("n")).otherwise(0).cast("bigint") - F.col("was")
    now.append("refs", found.select("key", "at", "ref", "side", F.col("added").alias("n"), change.alias("change")).where("n > 0 or change <> 0"))
    drop(asked, *([] if touched is None else [touched]))
    return now


def compacted(state: OrphanState) -> OrphanState:
    """The same state as one batch, its earlier folders deleted: for a log of very many batches. Earlier states can't be read any more."""
    now = replace(state, batch=state.batch + 1, base=state.batch + 1)
    now.append("index", state.log("index").groupBy("key", "at").agg(F.sum("opened").alias("opened"), F.sum("seen").alias("seen")))
    now.append("refs", state.current().select("key", "at", "ref", "side", "n", F.col("orphans").alias("change")))
    delete(state.spark, *(f"{state.path}/{kind}/batch={k}" for kind in ("index", "refs") for k in range(state.base, state.batch + 1)))
    return now


def replay(events: DataFrame, refs: DataFrame, bounds: list):
    """States after each batch: what is known up to each of `bounds` (timestamps, ascending), then all the rest.

    `events` and `refs` carry `known`; null is known from the start.
    """
    known, state, last = F.col("known"), None, None
    for at in [*bounds, None]:
        inside = F.lit(True) if last is None else known > F.lit(last)
        inside = inside if at is None else inside & (known <= F.lit(at))
        if last is None:
            inside = F.coalesce(inside, F.lit(True))
        state = advance(state, events.where(inside).drop("known"), refs.where(inside).drop("known"))
        last = at
        yield at, state
