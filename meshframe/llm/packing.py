"""Filling fixed-capacity containers with items: mixture-controlled packing by deficit round-robin.

Each source is a queue. Every window holds as many tokens as its containers, and a queue gains its target share of them;
it serves items while its deficit covers them, and what is left is carried into the next window. When a queue runs dry, the
others share its part in proportion to their targets, so that windows stay full. The loop has a closed form: a queue with
target r has served the item that ends at E of it at the virtual time v = E / r, when all queues together have served
T(v) = sum of min(target * v, size of the queue); the window is T(v) over the window's tokens. E is a prefix sum over the
queue in two levels (totals of hashed blocks of each queue, then sums inside a block), so that deficits carry over windows
and partitions without a queue ever being in one task.

Each window is packed on its own by best-fit decreasing. The items of containers that stay underfilled are packed again with
those of the neighbouring windows of a super-window, so that windows cost no space; they keep the number of the window that
served them, so the mixture of a window is that of its items, whichever container they are in.

A text longer than the capacity is divided into pieces of the capacity and a rest; no other text is divided.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.runtime import cut, drop

#: Containers a window, and windows a super-window.
WINDOW, SUPER = 64, 256
#: Share of the capacity below which a container counts as underfilled.
FULL = 0.999
#: Items a block of a queue.
BLOCK = 50_000
#: Fixed value: how the rank file's tokenizer splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer(path: str):
    """The public byte-level tokenizer whose ranks are at `path`."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def run(batches):
        import pyarrow as pa
        import regex

        t, pattern = tokenizer(path), regex.compile(PATTERN)

        def count(text: str) -> int:
            try:
                return len(t.encode_ordinary(text))
            except BaseException as e:  # the splitter gives up on some very long runs; its error is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                return sum(len(t._encode_single_piece(m.group())) for m in pattern.finditer(text))  # split without a limit

        for b in batches:
            n = [count(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def measured(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with a text; sources are compared without regard to case and blanks."""
    x = documents.where("text is not null").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), "text")
    return x.mapInArrow(_counter(path), "doc_id bigint, source string, n_tokens bigint")


def windows(items: DataFrame, total: int, rows: int, capacity: int, targets: dict[str, float] | None = None, containers: int | None = None) -> DataFrame:
    """items (doc_id, source, piece, size) with `window`, the round of deficit round-robin that serves them.

    targets: shares of a window's tokens by source, above 0; sources that it lacks share what is left of 1, or else an
    eighth beside it, by their sizes. Without targets, every source has its share of the corpus. A window has `containers`
    containers (WINDOW). Items of size 0 are spread over all windows.
    """
    if any(not r > 0 for r in (targets or {}).values()):
        raise ValueError("targets must be above 0")
    n_blocks = max(1, rows // BLOCK)
    x = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_blocks)).cast("int"))
    per_block = x.groupBy("source", "block").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("source", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size"), F.sum("size").over(Window.partitionBy("source")).alias("of_source"))
    goal = float((containers or WINDOW) * capacity)
    targets = targets or {}
    # sources without a target run dry together, so they are one queue here: a row a target is all that is collected
    named = F.when(F.col("source").isin(*targets), F.col("source")) if targets else F.lit(None).cast("string")
    sizes = {r[0]: float(r[1] or 0) for r in items.groupBy(named.alias("source")).agg(F.sum("size")).collect()}
    rest = max(1 - sum(targets.values()), 0) or 0.125
    rates = [(targets.get(k, rest), n) for k, n in sizes.items()]
    share = F.lit(rest) * F.col("of_source") / F.lit(max(sizes.get(None, 0.0), 1.0))
    if targets:
        share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in targets.items() for v in kv]), F.col("source")), share)
    carried = offsets.select("source", "block", F.lit(None).cast("bigint").alias("doc_id"), F.lit(-1).alias("piece"), "size", share.alias("rate"))
    line = carried.unionByName(x.select("source", "block", "doc_id", "piece", "size", F.lit(None).cast("double").alias("rate")))
    upto = Window.partitionBy("source", "block").orderBy("piece_0", "doc_id", "piece").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("piece_0", F.when(F.col("piece") < 0, 0).otherwise(1)).select("*", F.sum("size").over(upto).alias("end"), F.max("rate").over(upto).alias("r"))
    time = F.col("end") / F.col("r")
    served = reduce(lambda a, b: a + b, [F.least(F.lit(rate) * time, F.lit(n)) for rate, n in rates], F.lit(0.0))
    n_windows = max(1, -(-total // int(goal)))
    at = F.when(F.col("size") == 0, F.pmod(F.xxhash64("doc_id"), F.lit(n_windows))).otherwise(F.greatest(F.ceil(served / goal - 1e-9) - 1, F.lit(0)))
    return line.where("piece >= 0").select("doc_id", "source", "piece", "size", at.cast("bigint").alias("window"))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers by container. Sizes are at most the capacity. Ties go to the earlier item."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: list[int] = []  # distinct amounts of free space, ascending
    by_room: dict[int, list[int]] = defaultdict(list)
    out: list[list[int]] = []
    for i in order:
        if out and not sizes[i]:  # takes no room, so it goes anywhere
            out[-1].append(i)
            continue
        k = bisect_left(room, sizes[i])
        if k < len(room):
            free = room[k]
            c = by_room[free].pop()
            if not by_room[free]:
                room.pop(k)
            out[c].append(i)
        else:
            free, c = capacity, len(out)
            out.append([i])
        free -= sizes[i]
        if free:
            if not by_room[free]:
                insort(room, free)
            by_room[free].append(c)
    return out


def _packer(capacity: int, level: int):
    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "source", "piece", "size", "window", "together", "level", "number", "place", "start", "fill"]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 4]

        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in names[:6]), strict=True)

        for _, group in groupby(rows(), key=lambda r: r[5]):
            items = list(group)
            out = []
            for number, chosen in enumerate(best_fit([r[3] for r in items], capacity)):
                fill, start = sum(items[i][3] for i in chosen), 0
                for place, i in enumerate(chosen):
                    out.append((*items[i], level, number, place, start, fill))
                    start += items[i][3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _packed(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """items (doc_id, source, piece, size, window, together) packed: those that have `together` alike go into common containers."""
    x = items.select("doc_id", "source", F.col("piece").cast("bigint").alias("piece"), "size", "window", "together").repartition("together").sortWithinPartitions("together", F.desc("size"), "doc_id", "piece")
    return x.mapInArrow(_packer(capacity, level), "doc_id bigint, source string, piece bigint, size bigint, window bigint, together bigint, level int, number bigint, place bigint, start bigint, fill bigint")


def pack(sizes: DataFrame, capacity: int, targets: dict[str, float] | None = None, containers: int | None = None) -> DataFrame:
    """(doc_id, source, piece, size, from_token, container, place, start, fill, window) from (doc_id, source, n_tokens).

    container is a number unique over all; place counts the pieces in a container from 0, start is the piece's first token
    in it, fill what the container holds. Pieces count from 0, from_token is the piece's first token in its text; window is
    the round that served it (see windows()). A text of no tokens takes a place without room. Sizes that are null are left
    out; empty sizes give no rows.
    """
    items = sizes.where("n_tokens is not null").withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int") - 1, F.lit(0)))))
    items = cut(items.select("doc_id", "source", "piece", F.least(F.col("n_tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("size")), also=F.sum("size"))
    served = windows(items, items.also or 0, items.n_rows, capacity, targets, containers)
    first = cut(_packed(served.withColumn("together", F.col("window")), capacity, 0))
    drop(items)
    under = F.col("fill") < F.lit(int(capacity * FULL))
    carried = first.where(under).select("doc_id", "source", "piece", "size", "window", F.floor(F.col("window") / SUPER).alias("together"))
    out = first.where(~under).unionByName(_packed(carried, capacity, 1))
    number = (F.col("together") * 2 + F.col("level")) * F.lit(1 << 24) + F.col("number")
    return out.select("doc_id", "source", "piece", "size", (F.col("piece") * capacity).alias("from_token"), number.alias("container"), "place", "start", "fill", "window")


def faults(packed: DataFrame, capacity: int, spare: float, targets: dict[str, float] | None = None, containers: int | None = None) -> DataFrame:
    """(what, n): how often a packing breaks a rule, and the number of texts that it places.

    Each piece once; no container beyond the capacity; places and starts in order; no more containers than the tokens need
    at least plus a share `spare` and one. With targets, the share of every source with one in every window that begins before any
    of them has run dry is off by less than one item of the capacity.
    """
    x = cut(packed)
    by = x.groupBy("container").agg(F.sum("size").alias("size"), F.max("fill").alias("fill"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"), F.countDistinct("place").alias("places"), F.max(F.col("start") + F.col("size")).alias("end"))
    texts = x.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("pieces"), F.max(F.col("from_token") + F.col("size")).alias("end"))
    tokens = by.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    count = lambda df, what, cond: df.agg(F.lit(what).alias("what"), F.count_if(cond).alias("n"))
    out = [
        count(texts, "texts", F.lit(True)),
        count(texts, "texts in parts missing or repeated", (F.col("n") != F.col("pieces")) | (F.col("end") != F.col("size"))),
        count(by, "containers beyond capacity", (F.col("size") > capacity) | (F.col("size") != F.col("fill"))),
        count(by, "containers out of order", (F.col("n") != F.col("places")) | (F.col("last") != F.col("n") - 1) | (F.col("end") != F.col("size"))),
        count(tokens, "too many containers", F.col("n") > F.ceil(F.col("size") / capacity) * (1 + spare) + 1),
    ]
    if targets:
        goal = (containers or WINDOW) * capacity
        got = x.where(F.col("source").isin(*targets)).groupBy("source", "window").agg(F.sum("size").alias("size"))
        dry = got.groupBy("source").agg(F.max("window").alias("last")).agg(F.min("last")).first()[0] or 0
        want = F.try_element_at(F.create_map(*[F.lit(v) for kv in targets.items() for v in kv]), F.col("source")) * goal
        out.append(count(got, "windows off target", (F.col("window") < dry) & (F.abs(F.col("size") - want) > capacity)))
    return reduce(DataFrame.unionByName, out)
