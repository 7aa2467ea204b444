from datetime import datetime

import pytest
import regex
from conftest import rows
from pyspark.sql import functions as F

from meshframe.llm import packing, survive

D = datetime(2024, 1, 1)
META = "struct<name string, str_metric string, date_metric timestamp_ntz, feed string>"


def test_survivors(spark):
    data = [
        (1, "A-1", [None, float("nan")], ("n/a", "x", D, "good")),
        (2, "{a1}", [0.0], ("late", None, D, "poor")),
        (3, "a1", [2.0], ("early", "  ", None, "poor")),
        (4, "a1", None, ("unlisted", "y", datetime(2025, 1, 1), "what")),
        (5, "b", [1.0], ("one", "x", D, "good")),
        (6, "c", [], ("--", None, None, None)),
        (7, "C", None, (None, "tbd", None, None)),
        (8, "d", [1.0], ("n", "m", D, None)),
        (9, "d", [1.0], ("n", "m", D, None)),
        (10, "--", [1.0], ("n", "m", D, "good")),
        (11, None, [1.0], ("n", "m", D, "good")),
        (12, "--", [1.0], None),
        (13, "d", [5.0], None),
    ]
    rec = spark.createDataFrame(data, f"rec_id bigint, uid string, node_value array<double>, meta {META}").withColumn("trust", F.lit("clash")).withColumn("feed", F.lit("clash"))
    trust = spark.createDataFrame([("good", 5), ("poor", 1), (None, 9)], "feed string, trust int")
    out = {r.uid: r for r in survive.node_survivors(rec, trust).collect()}
    pick = {u: tuple(r[f] and r[f].rec_id for f in ("node_value", "name", "str_metric")) for u, r in out.items()}
    assert pick == {"a1": (2, 2, 1), "c": (None, None, None), "d": (8, 8, 8)}
    assert out["a1"].n_rows == 4 and out["a1"].name.value == "late"
    assert survive.node_survivors(rec.limit(0), trust.limit(0)).isEmpty()


def check(packed, sizes, capacity):
    by, docs = {}, {}
    for r in packed:
        by.setdefault(r.container, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    for x in by.values():
        x.sort(key=lambda r: r.place)
        assert [r.place for r in x] == list(range(len(x)))
        assert all(r.start == sum(q.size for q in x[:k]) for k, r in enumerate(x))
        assert sum(r.size for r in x) == x[0].fill <= capacity
    assert {d: sum(r.size for r in x) for d, x in docs.items()} == sizes
    for d, x in docs.items():
        assert len(x) == max(1, -(-sizes[d] // capacity))
        assert sorted(r.from_token for r in x) == [k * capacity for k in range(len(x))]
    return len(by)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 4)
    monkeypatch.setattr(packing, "SUPER", 8)
    monkeypatch.setattr(packing, "BLOCK", 50)
    sizes = {i: (i * 37) % 90 if i % 50 else 250 + i for i in range(400)} | {1000: 0, 1001: 100, 1002: 1000}
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 7}", n) for i, n in sizes.items()] + [(5000, "x", None)], "doc_id bigint, source string, n_tokens bigint").withColumn("window", F.lit("clash"))
    packed = packing.pack(df, 100).collect()
    used, least = check(packed, sizes, 100), -(-sum(sizes.values()) // 100)
    assert used <= least * 1.06 + 1
    assert packing.pack(df.limit(0), 100).isEmpty()


def test_mixture(spark, monkeypatch):
    """Windows hold the wanted shares while the sources last; deficits carry from window to window."""
    monkeypatch.setattr(packing, "WINDOW", 10)
    df = spark.createDataFrame([(i, "a" if i < 600 else "b", 10) for i in range(1200)], "doc_id bigint, source string, n_tokens bigint")
    packed = packing.windows(df.select("doc_id", "source", F.lit(0).alias("piece"), F.col("n_tokens").alias("size")), 12000, 1200, 100, {"a": 0.75, "b": 0.25})
    got = {(r.window, r.source): r.n for r in packed.groupBy("window", "source").agg(F.sum("size").alias("n")).collect()}
    assert all(abs(got[w, "a"] - 750) <= 10 and abs(got[w, "b"] - 250) <= 10 for w in range(7))
    # then "b" has windows of its own, as full as the others, and the packed containers hold what their windows hold
    assert sum(got.values()) == 12000 and {w for w, _ in got} == set(range(12)) and all(got[w, "b"] == 1000 for w in range(8, 12))
    packed = packing.pack(df, 100, {"a": 0.75, "b": 0.25}).collect()
    again = {}
    for r in packed:
        again[r.window, r.source] = again.get((r.window, r.source), 0) + r.size
    assert again == got and check(packed, {i: 10 for i in range(1200)}, 100) == 120
    with pytest.raises(ValueError):
        packing.windows(df, 1, 1, 100, {"a": 0.0})


def test_mixture_with_other_sources(spark, monkeypatch):
    """Sources without a target share the rest by their sizes; many windows, uneven items, carried over super-windows."""
    monkeypatch.setattr(packing, "SUPER", 3)
    sizes = {i: 5 + (i * 31) % 60 for i in range(2000)}
    df = spark.createDataFrame([(i, "a" if i % 4 == 0 else f"o{i % 3}", n) for i, n in sizes.items()], "doc_id bigint, source string, n_tokens bigint")
    packed = packing.pack(df, 100, {"a": 0.5}, 10)
    assert rows(packing.faults(packed, 100, 0.06, {"a": 0.5}, 10)) == sorted([("texts", 2000), *((w, 0) for w in ("texts in parts missing or repeated", "containers beyond capacity", "containers out of order", "too many containers", "windows off target"))], key=repr)
    check(packed.collect(), sizes, 100)
    of = {(r.window, r.source): r.n for r in packed.groupBy("window", "source").agg(F.sum("size").alias("n")).collect()}
    assert abs(of[5, "a"] - 500) <= 65 and all(abs(of[5, f"o{k}"] - 500 / 3) <= 65 for k in range(3))
    late = packed.groupBy("source").agg(F.max("window").alias("last")).agg(F.min("last")).first()[0]
    assert late >= 5
    wrong = packed.withColumn("window", F.greatest(F.col("window"), F.lit(3))).withColumn("place", F.col("place") + 1)
    found = {r.what: r.n for r in packing.faults(wrong, 100, 0.02, {"a": 0.5}, 10).collect()}
    assert found["containers out of order"] and found["windows off target"]


def test_best_fit():
    assert packing.best_fit([5, 5, 4, 3, 3], 10) == [[0, 1], [2, 3, 4]]
    assert packing.best_fit([], 10) == [] and packing.best_fit([0, 10, 0], 10) == [[1, 0, 2]]


def test_measured(spark):
    text = ["", "one two", "x" * 60_000 + " " * 60_000, None, "日本語 and `code`"]
    df = spark.createDataFrame([(i, " Src" if i else None, t) for i, t in enumerate(text)], "doc_id bigint, source string, text string")
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    got = {r.doc_id: (r.source, r.n_tokens) for r in packing.measured(df, path).collect()}
    t = packing.tokenizer(path)
    by_hand = [*regex.findall(packing.PATTERN, text[2])]
    assert got[2][1] == sum(len(t.encode_ordinary(x)) if len(x) < 1000 else len(t._encode_single_piece(x)) for x in by_hand)
    assert set(got) == {0, 1, 2, 4} and got[0] == ("", 0) and got[1] == ("src", len(t.encode_ordinary("one two"))) and got[4][1] == len(t.encode_ordinary(text[4]))
    assert rows(packing.measured(df.limit(0), path)) == []
