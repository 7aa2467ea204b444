"""Evaluation texts leaking into training text: an FM-index per training shard.

A shard is a run of documents of a partition: its words are numbers of its own vocabulary, one separator stands between
documents. index() builds an FM-index over every shard (Burrows-Wheeler transform as a wavelet matrix, sampled suffix
positions) and writes it as a row of a table, which any phrases can be searched in, again and again, without the texts.

Test phrases are all runs of `LENGTH` words of the items. They are sent to the shards in blocks of bounded size, one block
after another: all phrases of a block are searched backward at once, occurrences are located by walking to the next sampled
position and attributed to the items that have the phrase. Removal spans are merged in a shard, and then over the blocks.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm.words import word_spans, words
from meshframe.runtime import cut, drop

#: Words that must agree, one after another.
LENGTH = 12
#: Symbols of a shard, beyond which a new one begins; a longer document is a shard of its own.
SHARD = 1 << 19
#: Characters of items, about, that are searched at once: their phrases are sent to every task. More items take further passes over the index.
BLOCK_CHARS = 4_000_000
SAMPLE = 16
#: Symbols that end the text, and stand between documents; words follow.
END, BETWEEN, FIRST = 0, 1, 2


class WaveletMatrix:
    """Over symbols of `bits` bits: rank(c, i), the occurrences of c before position i, and access(i), for arrays at once."""

    def __init__(self, levels: list[np.ndarray]):
        self.bits = len(levels)
        self.ones, self.zeros = [], []
        for bit in levels:
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))

    @staticmethod
    def levels(x: np.ndarray, n_symbols: int) -> list[np.ndarray]:
        out = []
        for level in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = ((x >> level) & 1).astype(bool)
            out.append(bit)
            x = np.concatenate([x[~bit], x[bit]])
        return out

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (c >> (self.bits - 1 - level)) & 1
            l1, h1 = ones[lo], ones[hi]
            lo, hi = np.where(bit == 1, zeros + l1, lo - l1), np.where(bit == 1, zeros + h1, hi - h1)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and their ranks there."""
        c, lo = np.zeros_like(i), np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[i + 1] > ones[i]
            c = c * 2 + bit
            lo, i = np.where(bit, zeros + ones[lo], lo - ones[lo]), np.where(bit, zeros + ones[i], i - ones[i])
        return c, i - lo


def suffix_order(x: np.ndarray, n_symbols: int) -> np.ndarray:
    """Start of each suffix in order; x ends with a symbol that is smallest and occurs once.

    As many symbols as a number holds are sorted at once, then ranks double; only suffixes that still tie are sorted again.
    """
    n, bits = len(x), max(1, int(n_symbols - 1).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: max(0, n - j)] |= x[j:]
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)
    at = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    at = at[~(new & np.append(new[1:], True))]
    while len(at):
        tied = order[at]
        after = np.zeros(len(tied), np.int64)
        inside = tied + k < n
        after[inside] = rank[tied[inside] + k] + 1
        key = rank[tied] * (n + 2) + after
        o = np.argsort(key)
        tied, key = tied[o], key[o]
        order[at] = tied
        new = np.append(True, key[1:] != key[:-1])
        rank[tied] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.append(new[1:], True))]
        k *= 2
    return order


class FMIndex:
    """Backward search in a text of symbols >= 1, from the parts that build() makes and a table holds."""

    @staticmethod
    def build(text: np.ndarray, n_symbols: int) -> dict:
        x = np.append(text, END).astype(np.int64)
        order = suffix_order(x, n_symbols)
        sampled = order % SAMPLE == 0
        levels = WaveletMatrix.levels(x[order - 1], n_symbols)
        return {
            "n": len(x),
            "tree": b"".join(np.packbits(b).tobytes() for b in levels),
            "before": np.append(0, np.cumsum(np.bincount(x, minlength=n_symbols))).astype(np.int32).tobytes(),
            "sampled": np.packbits(sampled).tobytes(),
            "samples": order[sampled].astype(np.int32).tobytes(),
        }

    def __init__(self, n: int, tree: bytes, before: bytes, sampled: bytes, samples: bytes):
        bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
        size = -(-n // 8)
        self.n, self.before = n, np.frombuffer(before, np.int32).astype(np.int64)
        self.tree = WaveletMatrix([bits(tree[k : k + size]) for k in range(0, len(tree), size)])
        self.sampled, self.samples = bits(sampled), np.frombuffer(samples, np.int32).astype(np.int64)
        self.sample_at = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of the suffixes that begin with each phrase (one a row of the matrix)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        gone = np.ones(len(phrases), bool)
        gone[live] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.sampled[at]
            out[left[hit]] = self.samples[self.sample_at[at[hit]]] + steps[left[hit]]
            left, at = left[~hit], at[~hit]
            steps[left] += 1
            c, rank = self.tree.access(at)
            at = self.before[c] + rank
        return out

    def occurrences(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text position, phrase number) of all occurrences of the phrases."""
        lo, hi = self.search(phrases)
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)
        return self.locate(rows), np.repeat(hit, n)


class Phrases:
    """The distinct phrases of a block of items: its words, a matrix of their numbers, and the items of each phrase."""

    def __init__(self, items: list[tuple[int, str]]):
        number: dict[str, int] = {}
        seen: dict[tuple, set[int]] = {}
        for item, text in items:
            ids = [number.setdefault(w, len(number)) for w in words(text)]
            for i in range(len(ids) - LENGTH + 1):
                seen.setdefault(tuple(ids[i : i + LENGTH]), set()).add(item)
        self.words = list(number)
        self.matrix = np.array(list(seen), np.int32).reshape(-1, LENGTH)
        self.items = [sorted(x) for x in seen.values()]

    def of(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The phrases whose words are all in a shard's vocabulary, by its numbers, and which they are."""
        number = dict(zip(vocabulary, range(FIRST, FIRST + len(vocabulary)), strict=True))
        there = np.array([number.get(w, 0) for w in self.words], np.int64)
        if not len(self.matrix):
            return np.zeros((0, LENGTH), np.int64), np.zeros(0, np.int64)
        which = np.flatnonzero((there > 0)[self.matrix].all(axis=1))
        return there[self.matrix[which]], which


_SHARD = "shard string, n int, tree binary, before binary, sampled binary, samples binary, words binary, docs array<bigint>, starts array<int>, places binary"


def _indexed(places: bool):
    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = [c.split()[0] for c in _SHARD.split(", ")]
        task, made = uuid4().hex, 0
        number: dict[str, int] = {}
        text: list[int] = []
        where: list[tuple[int, int]] = []
        docs: list[int | None] = []
        starts: list[int] = []

        def row():
            nonlocal made
            made += 1
            at = np.array(where, np.int32).reshape(-1, 2).tobytes() if places else None
            out = {"shard": f"{task}{made:x}", "words": "\n".join(number).encode("utf-8", "surrogatepass"), "docs": [*docs], "starts": [*starts], "places": at}
            out |= FMIndex.build(np.array(text, np.int64), FIRST + len(number))
            for x in (number, text, where, docs, starts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([out[c]], t) for c, t in zip(names, kinds, strict=True)], names=names)

        for b in batches:
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = words(t)
                if len(found) < LENGTH:
                    continue
                docs.append(doc)
                starts.append(len(text))
                add = number.setdefault
                text += [add(w, len(number) + FIRST) for w in found]
                text.append(BETWEEN)
                if places:
                    where += [*word_spans(t), (0, 0)]
                if len(text) >= SHARD:
                    yield row()
        if docs:
            yield row()

    return run


def index(documents: DataFrame, places: bool = False) -> DataFrame:
    """The shards of the documents' texts as a written table, one row an FM-index; with the words' `places` in the texts if asked for.

    Texts that are null or have fewer than LENGTH words hold no phrase and are left out.
    """
    return cut(documents.select("doc_id", "text").where("text is not null").mapInArrow(_indexed(places), _SHARD))


def _merged(at: np.ndarray, which: np.ndarray, phrases: Phrases) -> list[tuple[int, int, list[int]]]:
    """(first word, last word + 1, items) of overlapping or touching occurrences, given in order."""
    out: list[tuple[int, int, set[int]]] = []
    for i, f in zip(at.tolist(), which.tolist(), strict=True):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], i + LENGTH, out[-1][2] | set(phrases.items[f]))
        else:
            out.append((i, i + LENGTH, set(phrases.items[f])))
    return [(a, b, sorted(x)) for a, b, x in out]


def _searched(shared, spans: bool):
    def run(batches):
        import pyarrow as pa

        phrases = shared.value
        names = ["shard", "number", "doc_id", "items", "first", "last", "start_pos", "end_pos"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 4]
        for b in batches:
            for r in b.to_pylist():
                wanted, which = phrases.of(r["words"].decode("utf-8", "surrogatepass").split("\n"))
                out = []
                if len(wanted):
                    at, hit = FMIndex(*(r[c] for c in ("n", "tree", "before", "sampled", "samples"))).occurrences(wanted)
                    o = np.argsort(at, kind="stable")
                    at, hit = at[o], which[hit[o]]
                    doc = np.searchsorted(np.array(r["starts"]), at, side="right") - 1
                    places = np.frombuffer(r["places"], np.int32).reshape(-1, 2) if spans else None
                    for d in np.unique(doc).tolist():
                        mine = doc == d
                        if not spans:
                            items = sorted({i for f in hit[mine].tolist() for i in phrases.items[f]})
                            out.append((r["shard"], d, r["docs"][d], items, 0, 0, 0, 0))
                            continue
                        for first, last, items in _merged(at[mine], hit[mine], phrases):
                            out.append((r["shard"], d, r["docs"][d], items, first, last, int(places[first, 0]), int(places[last - 1, 1])))
                cols = list(zip(*out, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


_HIT = "shard string, number int, doc_id bigint, items array<bigint>, first bigint, last bigint, start_pos bigint, end_pos bigint"


def search(shards: DataFrame, items: DataFrame, spans: bool) -> DataFrame:
    """Rows (shard, number and id of a document, items, and with `spans` word and text positions) of what shards hold of the items.

    Items go through the driver a block at a time (about BLOCK_CHARS; all texts of an item are in one), and a block's
    phrases are released before the next; hits are written tables.
    """
    sc = shards.sparkSession.sparkContext
    x = cut(items.select("item_id", "text").where("item_id is not null and text is not null").distinct(), also=F.sum(F.length("text")))
    n_blocks, found = max(1, -(-(x.also or 0) // BLOCK_CHARS)), []
    for k in range(n_blocks):
        block = x.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        phrases = sc.broadcast(Phrases([(r.item_id, r.text) for r in block.toLocalIterator()]))
        found.append(cut(shards.mapInArrow(_searched(phrases, spans), _HIT)))
        phrases.destroy()
    drop(x)
    return reduce(DataFrame.unionByName, found)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds at least LENGTH consecutive words of the item's whole text.

    Null texts hold nothing, items shorter than LENGTH words are found nowhere, repeated rows give repeated rows; empty
    tables give no rows.
    """
    shards = index(documents)
    found = search(shards, items, False)
    drop(shards)
    return found.select("doc_id", F.explode("items").alias("item_id"))


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, n_words, items): what to cut out, in code points; items as ids separated by commas.

    Spans of a row of documents don't overlap or touch.
    """
    shards = index(documents, places=True)
    found = search(shards, items, True)
    drop(shards)
    # the blocks' spans of a document once more: a document's spans are as few as its words
    line = Window.partitionBy("shard", "number").orderBy("first", "last")
    before = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("first") > before), 1).otherwise(0)
    x = found.withColumn("new", new).withColumn("span", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min("first").alias("first"), F.max("last").alias("last"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")]
    x = x.groupBy("shard", "number", "doc_id", "span").agg(*ends, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return x.select("doc_id", "start_pos", "end_pos", (F.col("last") - F.col("first")).alias("n_words"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))
