"""All pairs of records whose sets overlap above a similarity threshold: T-occurrence list merging.

Exact copies become one class. Elements are ordered by frequency, rare ones first. Two sets with Jaccard similarity >= t share
an element among the first few of each (prefix), so the inverted lists are partitioned by prefix element: a set probes the
partition of each of its prefix elements, and is list content there only for the still shorter prefix that suffices for the
smaller set of a pair. Partitions of elements in more than `HOT` sets are parted by the size of the listed set, in steps of
1 / t: a set is listed in its own step and probes the two or three that its smaller partners can be of. In a partition, every set probes the inverted lists of the others: the lists of its elements are merged with a heap that skips
what can't reach the required count, the longest lists are left out of the merge and searched by bisection for the
candidates that remain.

No frequent element makes a hot group, and none loses a pair:

* Where sets are so small that their prefixes have few combinations, and every pair of the step must share that many
  elements, a partition of such an element is keyed by the first two or three common elements instead
  (at most `MORE` times as many rows as the prefix has places; the depth depends on the step alone, so both sets of a pair
  agree on it).
* Any partition that is still too large is a grid: its listed sets are divided into blocks of about `LISTED` elements, and
  the sets that probe them into parts of about `PROBED`; each cell is a group of its own.

A pair is emitted only where the partition's key is its first common elements and one of the two probes: once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, groupby
from math import comb, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.llm.arrow import lists
from meshframe.runtime import BROADCAST_ROWS, cut, drop, lookup

#: Number of sets that hold an element, beyond which its partitions are keyed by further common elements where these are few.
HOT = 2000
#: The step of a partition that isn't parted by size.
ANY = -1
#: Number of sets that hold an element, up to which it counts as rare.
FEW = 8
#: Rows that such keys may make, as a multiple of the places of a prefix.
MORE = 4
#: Elements of the listed sets of a cell, and of the sets that probe it.
LISTED, PROBED = 1 << 20, 1 << 22
#: Members up to which a class of exact copies is expanded into pairs of members; beyond it, see expand().
EXPAND = 100


def classes(sets: DataFrame, at_least: int) -> tuple[DataFrame, DataFrame]:
    """(side, node, items) -> members (side, node, k) and classes (side, k, rep, n_members, items) of equal sets.

    Items are reduced to distinct non-null ones; sets smaller than `at_least` are left out. If rows of one node differ,
    the largest of its sets (as arrays compare) counts.
    """
    items = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    x = sets.where("node is not null and items is not null").select("side", "node", items.alias("items")).where(F.size("items") >= at_least)
    x = x.groupBy("side", "node").agg(F.max("items").alias("items"))
    x = cut(x.withColumn("k", F.md5(F.concat_ws(",", "side", F.col("items").cast("array<string>")))))
    found = x.groupBy("side", "k").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n_members"), F.first("items").alias("items"))
    return x.select("side", "node", "k"), found


def _ranked(found: DataFrame) -> DataFrame:
    """(side, rep, els, dfs): the items of each class by frequency, rarest first, and their frequencies.

    Elements of up to FEW sets count as equally rare, so only the frequencies of the others have to be looked up.
    """
    one = found.select("side", "rep", F.explode("items").alias("e")).withColumn("se", F.struct("side", "e"))
    df = one.groupBy("se").agg(F.count(F.lit(1)).alias("df"))
    df = cut(df.where(F.col("df") > FEW), also=F.sum("df"))
    if df.n_rows <= BROADCAST_ROWS:  # ids and counts: a few MB
        one = one.join(F.broadcast(df.withColumnRenamed("se", "__k")), F.col("se") == F.col("__k"), "left")
    else:
        one = lookup(one, "se", df, "se", "df", "df", df.also, "left")
    x = one.groupBy("side", "rep").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1).cast("bigint")).alias("df"), "e"))).alias("x"))
    return x.select("side", "rep", F.col("x.e").alias("els"), F.col("x.df").alias("dfs"))


def _step(n: Column, num: int, den: int) -> Column:
    """The step of a set's size, ascending: sizes of a step differ by less than 1 / t."""
    return n if num == den else F.floor(F.ln(n) / F.lit(log(den / num))).cast("int")


def key_depths(num: int, den: int) -> list[int]:
    """By step, how many common elements can key a pair of a frequent first one; later steps: 1.

    All pairs of a step must share as many, and no prefix of a set that probes it may have too many combinations.
    """
    out: list[int] = []
    while num < den:
        lo, hi = (int((den / num) ** (len(out) + k) * (1 + (2 * k - 1) * 1e-9)) + k for k in (0, 1))
        required, n = -(-max(lo, 1) * num // den), hi * den // num + 1
        prefix = n + 1 - -(-n * num // den)
        depth = max(d for d in (1, 2, 3) if d == 1 or d <= required and comb(prefix + d - 1, d) <= MORE * prefix)
        if depth == 1 and prefix > 2 * MORE:
            break
        out.append(depth)
    return out


def _keys(ranked: DataFrame, num: int, den: int) -> DataFrame:
    """(side, step, key, listed, rep, els): each class once for each partition that it is sent to; t = num / den.

    Its probing prefix suffices for partners of any size (overlap >= t n), its listed prefix for partners that aren't
    smaller (overlap >= 2 t n / (1 + t)). The k-th common element of a pair is within k - 1 more places.
    """
    n = F.size("els")
    x = ranked.withColumn("probing", n - F.ceil(n * num / den).cast("int") + 1).withColumn("listing", n - F.ceil(n * (2 * num) / (num + den)).cast("int") + 1)
    x = x.withColumn("own", _step(n, num, den)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("probing") - 1)))
    steps = F.sequence(_step(F.ceil(n * num / den), num, den), F.col("own"))
    x = x.withColumn("step", F.explode(F.when(F.element_at("dfs", F.col("i") + 1) > HOT, steps).otherwise(F.array(F.lit(ANY)))))
    deep = F.array(*[F.lit(d) for d in key_depths(num, den) or [1]])
    x = x.withColumn("depth", F.when(F.col("step") > ANY, F.coalesce(F.get(deep, F.col("step")), F.lit(1))).otherwise(1))
    el = lambda c: F.element_at("els", F.col(c) + 1)

    def rows(y: DataFrame, *at: str) -> DataFrame:
        listed = F.col("step").isin(F.lit(ANY), F.col("own")) & (F.col(at[-1]) < F.col("listing") + (len(at) - 1))
        return y.select("side", "step", F.array(*[el(c) for c in at]).alias("key"), listed.alias("listed"), "rep", "els")

    two = x.where("depth > 1").withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("probing")))).where(F.col("j") < n)
    three = two.where("depth = 3").withColumn("l", F.explode(F.sequence(F.col("j") + 1, F.col("probing") + 1))).where(F.col("l") < n)
    return rows(x.where("depth = 1"), "i").unionByName(rows(two.where("depth = 2"), "i", "j")).unionByName(rows(three, "i", "j", "l"))


def merge_skip(lists: list[list[int]], need: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """(record, count) of the records in [lo, hi) that occur in at least `need` of the ascending lists."""
    spans = []
    for x in lists:
        a, b = bisect_left(x, lo), bisect_left(x, hi)
        if a < b:
            spans.append((b - a, a, b, x))
    if len(spans) < need:
        return []
    spans.sort(key=lambda s: s[0])
    n_long = 0
    if need > 1 and spans[-1][0] > 16:  # long lists are searched, not merged
        n_long = min(need - 1, sum(s[0] > 8 * spans[0][0] for s in spans))
    short, long = spans[: len(spans) - n_long], spans[len(spans) - n_long :]
    least = need - n_long
    heap = [(x[a], k, a) for k, (_, a, _, x) in enumerate(short)]
    heapify(heap)
    out = []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap))
        if len(popped) >= least:
            count = len(popped)
            for _, a, b, x in long:
                p = bisect_left(x, top, a, b)
                count += p < b and x[p] == top
            if count >= need:
                out.append((top, count))
            for _, k, p in popped:
                p += 1
                if p < short[k][2]:
                    heappush(heap, (short[k][3][p], k, p))
        else:
            while len(popped) < least - 1 and heap:
                popped.append(heappop(heap))
            if not heap:
                break
            skip_to = heap[0][0]
            for _, k, p in popped:
                x, b = short[k][3], short[k][2]
                p = bisect_left(x, skip_to, p + 1, b) if x[p] < skip_to else p
                if p < b:
                    heappush(heap, (x[p], k, p))
    return out


def _pairs_of(side: str, key: tuple, group: Iterator[tuple[bool, bool, int, list]], num: int, den: int) -> Iterator[tuple]:
    """Pairs of one partition. Its listed sets come first and go into inverted lists, in order of (size, rep); then every
    set that is to probe does so as it streams by: only the listed sets are held."""
    listed: list[tuple[int, int, list]] = []
    probing: list[tuple[int, list]] = []
    rest = None
    for is_listed, probes, rep, els in group:
        if not is_listed:
            rest = (rep, els)
            break
        listed.append((len(els), rep, els))
        if probes:
            probing.append((rep, els))
    if not listed:
        for _ in group:
            pass
        return
    listed.sort()
    order = [(n, rep) for n, rep, _ in listed]
    inverted: dict[int, list[int]] = {}
    shared = set(key)
    for k, (_, _, els) in enumerate(listed):
        for e in els:
            if e not in shared:
                inverted.setdefault(e, []).append(k)
    others = chain([rest] if rest else [], (r[2:] for r in group))
    for rep, els in chain(probing, others):
        n = len(els)
        least = -(-num * n // den)
        hi = bisect_left(order, (n, rep))
        lo = bisect_left(order, (least, -(1 << 63)))
        if lo >= hi:
            continue
        need = least - len(key)
        found = merge_skip([x for e in els if (x := inverted.get(e))], need, lo, hi) if need > 0 else [(k, -1) for k in range(lo, hi)]
        for k, _ in found:
            m, other, items = listed[k]
            both = set(items)
            common = [e for e in els if e in both]
            o = len(common)
            if den * o >= num * (n + m - o) and tuple(common[: len(key)]) == key:
                yield side, min(rep, other), max(rep, other), o


def _join(num: int, den: int):
    names = ("side", "key", "step", "block", "part", "listed", "probes", "rep", "els")

    def run(batches):
        import pyarrow as pa

        def rows():
            for b in batches:
                yield from zip(*((lists(b.column(c)) if c in ("key", "els") else b.column(c).to_pylist()) for c in names), strict=True)

        out: list[tuple] = []

        def batch():
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["side", "rep_lo", "rep_hi", "overlap"])

        for (side, key, *_), group in groupby(rows(), key=lambda r: (r[0], tuple(r[1]), *r[2:5])):
            for pair in _pairs_of(side, key, (r[5:] for r in group), num, den):
                out.append(pair)
                if len(out) > 10_000:
                    yield batch()
                    out.clear()
        yield batch()

    return run


def _in_cells(keyed: DataFrame) -> DataFrame:
    """keyed with (block, part, probes): a partition that is too large for a task becomes a grid of cells. A set is listed in
    all parts of its block and probes all blocks in its part; in any cell, it does one of the two or both."""
    size = F.size("els")
    # up to HOT sets of LISTED / HOT elements or fewer fit a cell, so they needn't be counted
    total = keyed.where((F.col("step") > ANY) | (size > LISTED // HOT)).groupBy("side", "step", "key").agg(F.sum(F.when(F.col("listed"), size).otherwise(0)).alias("n_listed"), F.sum(size).alias("n_probing"))
    total = total.where((F.col("n_listed") > LISTED) | ((F.col("n_probing") > PROBED) & (F.col("n_listed") > 0)))
    large = cut(total.select(F.struct("side", "step", "key").alias("__p"), F.ceil(F.col("n_listed") / LISTED).cast("int").alias("blocks"), F.ceil(F.col("n_probing") / PROBED).cast("int").alias("parts")))
    if not large.n_rows:
        drop(large)
        return keyed.select("*", F.lit(0).alias("block"), F.lit(0).alias("part"), F.lit(True).alias("probes"))
    large = F.broadcast(large) if large.n_rows <= BROADCAST_ROWS else large
    x = keyed.join(large, F.struct("side", "step", "key") == F.col("__p"), "left").drop("__p").fillna(1, ["blocks", "parts"])
    x = x.withColumn("own_block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("own_part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int"))
    cell = lambda b, p: F.struct(b.alias("block"), p.alias("part"))
    probing = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: cell(b, F.col("own_part")))
    listing = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: cell(F.col("own_block"), p))
    x = x.select("*", F.inline(F.when(F.col("listed"), F.array_union(probing, listing)).otherwise(probing)))
    return x.withColumn("listed", F.col("listed") & (F.col("block") == F.col("own_block"))).withColumn("probes", F.col("part") == F.col("own_part"))


def class_pairs(found: DataFrame, num: int, den: int) -> DataFrame:
    """(side, rep_lo, rep_hi, overlap) for all pairs of classes with |A & B| / |A | B| >= num / den, compared exactly."""
    ranked = cut(_ranked(found))
    group = ["side", "key", "step", "block", "part"]
    keyed = _in_cells(_keys(ranked, num, den))
    keyed = keyed.repartition(*group).sortWithinPartitions(*group, F.desc("listed"))
    return keyed.select(*group, "listed", "probes", "rep", "els").mapInArrow(_join(num, den), "side string, rep_lo bigint, rep_hi bigint, overlap int")


def _members(member: DataFrame, found: DataFrame) -> DataFrame:
    """(side, rep, nodes) of the classes with 2 to EXPAND members."""
    few = found.where((F.col("n_members") > 1) & (F.col("n_members") <= EXPAND)).select("side", "k", "rep")
    return member.join(few, ["side", "k"]).groupBy("side", "rep").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def expand(member: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(side, node_lo, node_hi): pairs of nodes from pairs of classes, and pairs within classes.

    A class of more than EXPAND copies is not expanded into pairs of its members: each member comes out paired with the
    smallest of them, and partners are paired with the smallest only; links() has every node's class.
    """
    nodes = cut(_members(member, found))
    one = lambda c, out: F.coalesce(c, F.array(F.col(out)))
    a, b = (nodes.select(F.col("side").alias(f"s{x}"), F.col("rep").alias(f"r{x}"), F.col("nodes").alias(f"n{x}")) for x in "ab")
    x = pairs.join(a, (F.col("side") == F.col("sa")) & (F.col("rep_lo") == F.col("ra")), "left")
    x = x.join(b, (F.col("side") == F.col("sb")) & (F.col("rep_hi") == F.col("rb")), "left")
    between = x.select("side", F.explode(one(F.col("na"), "rep_lo")).alias("p"), F.col("nb"), "rep_hi").select("side", "p", F.explode(one(F.col("nb"), "rep_hi")).alias("q"))
    inside = nodes.select("side", F.explode("nodes").alias("p"), "nodes").select("side", "p", F.explode("nodes").alias("q")).where("p < q")
    many = found.where(F.col("n_members") > EXPAND).select("side", "k", F.col("rep").alias("p"))
    star = member.join(many, ["side", "k"]).select("side", "p", F.col("node").alias("q")).where("p < q")
    return between.unionByName(inside).unionByName(star).select("side", F.least("p", "q").alias("node_lo"), F.greatest("p", "q").alias("node_hi"))


def links(member: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(side, node_id, class_id, n_links): one row a node: its class and the number of other classes that overlap with it."""
    ends = pairs.select("side", F.explode(F.array("rep_lo", "rep_hi")).alias("rep")).groupBy("side", "rep").agg(F.count(F.lit(1)).alias("n"))
    c = found.select("side", "k", "rep").join(ends, ["side", "rep"], "left").select(F.col("k").alias("key"), F.col("rep").alias("class_id"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_links"))
    x = lookup(member, "k", c.select("key", F.struct("class_id", "n_links").alias("c")), "key", "c", "c", member.count())
    return x.select("side", F.col("node").alias("node_id"), F.col("c.class_id").alias("class_id"), F.col("c.n_links").alias("n_links"))


def sides(inode: DataFrame) -> DataFrame:
    """(side, node, items) from INode rows."""
    both: list[Column] = [F.struct(F.lit(s).alias("side"), F.col(f"{s}_ids").alias("items")) for s in ("in", "out")]
    return inode.select(F.col("id").alias("node"), F.inline(F.array(*both)))
