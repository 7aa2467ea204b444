import random
import re
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from meshframe.functions.presence import canonical_uid, text_present
from meshframe.operators import orphans

T0 = datetime(2023, 1, 1)


def brute(parents, refs, known=None):
    out = set()
    for key, at, ref, side, came in refs:
        if key is None or known and came and came > known:
            continue
        mine = [(b, e) for k, b, e in parents if k == key and (known is None or b is None or b <= known)]
        alive = any(b is not None and b <= at and (e is None or e > at or known and e > known) for b, e in mine) if at else bool(mine)
        if not alive:
            out.add((ref, side))
    return out


def test_against_brute_force(spark):
    random.seed(5)
    day = lambda n: T0 + timedelta(days=random.randrange(n), hours=random.randrange(3))
    parents, refs = [], []
    for _ in range(200):
        b = random.choice([None, *[day(90)] * 9])
        e = random.choice([None, None, b, b and b + timedelta(days=random.randrange(30)), day(90)])
        parents.append((random.choice(["hot", f"k{random.randrange(30)}", None]), b, e))
    for i in range(600):
        refs.append((random.choice(["hot", "hot", f"k{random.randrange(40)}", None]), random.choice([None, day(100), day(100), day(100)]), i, random.choice("ab"), random.choice([None, day(100)])))
    p = spark.createDataFrame(parents, "uid string, b timestamp_ntz, e timestamp_ntz")
    r = spark.createDataFrame(refs, "key string, at timestamp_ntz, ref bigint, side string, known timestamp_ntz").withColumn("opened", F.lit("clash"))
    events = orphans.parent_events(p, F.col("uid"), "b", "e")
    times = [T0 + timedelta(days=30), T0 + timedelta(days=60)]
    for at, state in orphans.replay(events, r, times):
        got = {(x.ref, x.side) for x in state.refs.where("orphan").collect()}
        assert got == brute(parents, refs, at), at


def test_batches_touch_their_keys_only(spark):
    """What a batch reads of the log and what it writes doesn't depend on the size of the state."""
    written = []
    for n in (40, 400):
        refs = spark.range(n).selectExpr("concat('k', id) as key", "timestamp_ntz'2023-01-10' as at", "id as ref", "'a' as side")
        parents = spark.range(n).selectExpr("concat('k', id) as key", "timestamp_ntz'2023-01-01' as at", "1 as opened", "1 as seen").where("key not in ('k1', 'k2')")
        state = orphans.advance(None, parents, refs)
        assert {r.key for r in state.orphans().collect()} == {"k1", "k2"}
        one = spark.createDataFrame([("k1", T0 + timedelta(days=3), 1, 1), ("k3", T0 + timedelta(days=4), -1, 0)], "key string, at timestamp_ntz, opened bigint, seen bigint")
        touched = orphans.cut(one.selectExpr("key", "at as since", "true as seen").withColumn("bucket", state.bucket(F.col("key"))), also=F.min("since"))
        plan = orphans.affected(state, touched)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: [^\n]*bucket#\d+ (IN|INSET|=)", plan) and re.search(r"PushedFilters: [^\n]*GreaterThanOrEqual\(at,2023-01-04", plan), plan
        after = orphans.advance(state, one, refs.limit(0))
        written.append([after.log(k).where(F.col("batch") == 1).count() for k in ("index", "refs")])
        assert {r.key for r in after.orphans().collect()} == {"k2", "k3"} and {r.key for r in state.orphans().collect()} == {"k1", "k2"}
        late = spark.createDataFrame([("k5", T0 + timedelta(days=30), -1, 0)], "key string, at timestamp_ntz, opened bigint, seen bigint")
        last = orphans.advance(after, late, refs.where("key = 'k2'"))  # after the reference's date; and a reference once more
        assert sorted(r.key for r in last.orphans().collect()) == ["k2", "k2", "k3"] and last.counts().first().n_orphans == 3
        assert [(r.batch, r.n_orphans) for r in last.snapshots().orderBy("batch").collect()] == [(0, 2), (1, 2), (2, 3)]
        whole = rows(last.refs)
        assert rows(orphans.compacted(last).refs) == whole
    assert written[0] == written[1] == [2, 2]


def test_many_touched_keys(spark, monkeypatch):
    """Keys that aren't broadcast meet references by salt, with the same result."""
    monkeypatch.setattr(orphans, "BROADCAST_ROWS", 0)
    test_against_brute_force(spark)


def test_empty(spark):
    events = spark.createDataFrame([], "key string, at timestamp_ntz, opened bigint, seen bigint")
    refs = spark.createDataFrame([("a", None, 1, "a")], "key string, at timestamp_ntz, ref bigint, side string")
    state = orphans.advance(None, events, refs)
    assert rows(state.refs.where("orphan").select("ref")) == [(1,)]
    assert orphans.advance(None, events, refs.limit(0)).refs.isEmpty()


def test_presence(spark):
    x = spark.createDataFrame([(" A-1 ",), ("{a1}",), ("--",), (None,), ("",), ("Ａ１",)], "u string")
    assert [r[0] for r in x.select(canonical_uid(F.col("u"))).collect()] == ["a1", "a1", None, None, None, None]
    t = spark.createDataFrame([("ridge",), (" N/A ",), ("\t",), ("...",), (None,), ("none",), ("0",), ("nonesuch",)], "u string")
    assert [r[0] for r in t.select(text_present(F.col("u"))).collect()] == [True, False, False, False, False, False, True, True]
