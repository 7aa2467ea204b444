import random
from itertools import combinations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from meshframe.llm import groups, setjoin

random.seed(11)


def brute(sets, num=7, den=10, least=4):
    """(side, lo, hi) with |A & B| / |A | B| >= num / den among sets of at least `least`."""
    out = set()
    for (s, a), (t, b) in combinations(sorted((k for k in sets if len(sets[k]) >= least), key=repr), 2):
        x, y = sets[s, a], sets[t, b]
        if s == t and den * len(x & y) >= num * len(x | y):
            out.add((s, min(a, b), max(a, b)))
    return out


def made(n, hubs):
    out = {}
    for i in range(n):
        if i and random.random() < 0.5:
            base = set(out[random.choice("ab"), random.randrange(i)])
            for _ in range(random.randrange(3)):
                base ^= {random.choice([random.randrange(hubs), random.randrange(hubs, 400)])}
        else:
            base = set(random.sample(range(hubs), random.randrange(1, min(hubs, 9)))) | {random.randrange(hubs, 400) for _ in range(random.randrange(4))}
        out["a", i], out["b", i] = base, {x for x in base if random.random() < 0.9}
    return out


def frame(spark, sets):
    data = [(s, n, [*x, *list(x)[:1], None]) for (s, n), x in sets.items()]
    data += [(s, n, [*reversed(list(x))]) for (s, n), x in list(sets.items())[:20]]  # sent again
    data += [("a", None, [1, 2, 3, 4]), ("a", 9999, None), ("b", 9998, []), ("b", 9997, [None] * 5)]
    return spark.createDataFrame(data, "side string, node bigint, items array<bigint>").withColumn("k", F.lit("clash")).withColumn("rep", F.lit(1))


def found(df, num=7, den=10, least=4):
    member, classes = setjoin.classes(df, least)
    return setjoin.expand(member, classes, setjoin.class_pairs(classes, num, den))


@pytest.mark.parametrize("hot, hubs, size", [(2000, 12, 1 << 20), (3, 12, 1 << 20), (3, 5, 40), (1, 8, 10)])
def test_against_brute_force(spark, monkeypatch, hot, hubs, size):
    monkeypatch.setattr(setjoin, "HOT", hot)
    monkeypatch.setattr(setjoin, "LISTED", size)
    monkeypatch.setattr(setjoin, "PROBED", 2 * size)
    sets = made(120, hubs)
    got = rows(found(frame(spark, sets)))
    assert len(got) == len(set(got)) and set(got) == brute(sets)


@pytest.mark.parametrize("num, den, hot, size", [(1, 2, 1, 1 << 20), (1, 2, 1, 8), (9, 10, 1, 20), (1, 5, 1, 30), (1, 1, 1, 30)])
def test_small_sets_and_other_thresholds(spark, monkeypatch, num, den, hot, size):
    """Sets of one element up, all of it frequent: pairs with fewer common elements than a long key has aren't lost."""
    monkeypatch.setattr(setjoin, "HOT", hot)
    monkeypatch.setattr(setjoin, "LISTED", size)
    monkeypatch.setattr(setjoin, "PROBED", size)
    sets = {("a", i): {1, 2, 100 + i} for i in range(8)} | {("a", 20 + i): set(random.sample(range(6), random.randrange(1, 4))) for i in range(40)}
    sets |= {("b", i): set(random.sample(range(30), random.randrange(15, 30))) for i in range(40)}
    got = rows(found(frame(spark, sets), num, den, 1))
    assert len(got) == len(set(got)) and set(got) - {x for x in got if max(x[1:]) > 9000} == brute(sets, num, den, 1)


def test_rows_grow_with_the_prefix(spark, monkeypatch):
    """A set of frequent elements is sent to a few times as many partitions as its prefix has places, whatever its size."""
    monkeypatch.setattr(setjoin, "HOT", 1)
    for n in (4, 8, 16, 23, 40, 1000):
        ranked = spark.createDataFrame([("a", 1, list(range(n)), [9] * n)], "side string, rep bigint, els array<bigint>, dfs array<bigint>")
        prefix = n - -(-7 * n // 10) + 1
        assert setjoin._keys(ranked, 7, 10).count() <= 3 * setjoin.MORE * prefix, n


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "EXPAND", 3)
    sets = {("a", i): {1, 2, 3, 4, 5} for i in range(10, 15)} | {("a", 20): {1, 2, 3, 4}, ("a", 21): {9, 8, 7, 6}}
    member, classes = setjoin.classes(frame(spark, sets), 4)
    pairs = setjoin.class_pairs(classes, 7, 10)
    assert rows(setjoin.expand(member, classes, pairs)) == sorted([("a", 10, i) for i in range(11, 15)] + [("a", 10, 20)], key=repr)
    assert rows(setjoin.links(member, classes, pairs)) == sorted([("a", i, 10, 1) for i in range(10, 15)] + [("a", 20, 20, 1), ("a", 21, 21, 0)], key=repr)


def test_empty_sets(spark):
    assert found(spark.createDataFrame([], "side string, node bigint, items array<bigint>")).isEmpty()


def test_merge_skip():
    for _ in range(300):
        lists = [sorted(random.sample(range(60), random.choice([0, 2, 5, 50]))) for _ in range(random.randrange(1, 9))]
        need, lo, hi = random.randrange(1, 6), random.randrange(30), random.randrange(20, 61)
        want = {k: n for k in range(lo, hi) if (n := sum(k in x for x in lists)) >= need}
        assert dict(setjoin.merge_skip([x for x in lists if x], need, lo, hi)) == want


def union_find(pairs):
    p = {}

    def f(x):
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                f(x)
        if a is not None and b is not None:
            x, y = sorted((f(a), f(b)))
            p[y] = x
    return sorted((x, f(x)) for x in p)


@pytest.mark.parametrize(
    "pairs",
    [
        [(i, i + 1) for i in range(200)],
        [(i + 1, i) for i in range(0, 64, 2)] + [(i, i + 2) for i in range(0, 62, 2)],
        [(random.randrange(300), random.choice([None, random.randrange(300)])) for _ in range(250)] + [(5, 5), (None, None), (7, 8), (8, 7), (7, 8)],
        [(0, i) for i in range(1, 100)] + [(-5, 99)],
        [(3, 3), (None, 4)],
        [],
    ],
)
def test_components(spark, pairs):
    df = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("c", F.lit("clash")).withColumn("u", F.lit(0))
    got = rows(groups.components(df, "a", "b"))
    assert sorted(got) == union_find(pairs)


def test_hot_keys(spark, monkeypatch):
    """The way of hot keys gives the same groups."""
    import meshframe.llm.groups as g
    import meshframe.runtime as r

    monkeypatch.setattr(r, "hot_values", lambda df, key, rows: [x[0] for x in df.groupBy(key).count().where("count > 5").select(key).collect() if x[0] is not None])
    pairs = [(0, i) for i in range(1, 60)] + [(100 + i, 7) for i in range(40)] + [(500, 501)]
    assert sorted(rows(g.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b"))) == union_find(pairs)
