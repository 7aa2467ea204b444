import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from meshframe.operators import skew


def test_profile_heavy_percentile(spark):
    random.seed(3)
    data = [("f", 1 if random.random() < 0.5 else random.randrange(300), random.choice([None, float("nan"), 0.0, 1.5, -2.0, random.random() * 100])) for _ in range(3000)]
    data += [("f", None, 1.0), (None, 5, 1.0)]
    df = spark.createDataFrame(data, "f string, k int, v double").withColumn("n", F.lit(1)).withColumn("n_rows", F.lit("clash"))
    got = {r.k: r for r in skew.profile(df, ["f", "k"], "v").collect()}
    by = defaultdict(list)
    for f, k, v in data:
        if f is not None and k is not None:
            by[k].append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        there = [v for v in vs if v is not None and not math.isnan(v)]
        c = Counter(there)
        assert got[k].n_rows == len(vs) and got[k].n_values == len(c)
        assert (got[k].value_sum is None) == (not there) and math.isclose(got[k].value_sum or 0, sum(there), abs_tol=1e-6)
        assert got[k].mode_value == (min(c, key=lambda v: (-c[v], v)) if c else None)
    assert rows(skew.heavy(skew.profile(df, ["f", "k"], "v"), "f", "k", 0.1).select("k")) == [(1,)]
    q = {r.k: r.percentile for r in skew.percentile(df, ["f", "k"], "v", 0.5).collect()}
    for k, vs in by.items():
        there = sorted(v for v in vs if v is not None and not math.isnan(v))
        assert q.get(k) == (there[math.ceil(len(there) * 0.5) - 1] if there else None)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 1.0])
def test_percentile_of_narrow_slices(spark, monkeypatch, q):
    """Values within an eighth of an octave, far beyond what a task sorts, beside spread, equal, infinite and negative ones."""
    monkeypatch.setattr(skew, "SORTED", 5)
    monkeypatch.setattr(skew, "WAYS", 4)
    random.seed(4)
    data = [(1, 1 + random.random() / 1000) for _ in range(400)] + [(1, 1.0000001)] * 300
    data += [(2, x) for x in (float("inf"), -float("inf"), 0.0, -0.0, 1e-300, -1e300)] + [(3, 7.0)] * 50 + [(4, -1 - random.random() / 10**6) for _ in range(99)]
    got = {r.k: r.percentile for r in skew.percentile(spark.createDataFrame(data, "k int, v double"), ["k"], "v", q).collect()}
    for k in range(1, 5):
        there = sorted(v for x, v in data if x == k)
        assert got[k] == there[max(math.ceil(len(there) * q), 1) - 1]


def test_empty(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert skew.profile(df, ["k"], "v").isEmpty() and skew.percentile(df, ["k"], "v", 0.5).isEmpty()
