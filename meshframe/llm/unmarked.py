"""Sentence boundaries where no mark shows them: the hidden-event n-gram model over all gaps between words.

Words are a text's tokens without case and punctuation; in scripts without spaces, its characters. Every gap between two
words may hide a boundary token. A trigram model of words and boundary tokens is counted from the units of the corpus that
end with a mark, with Witten-Bell back-off; a word's history ends at a boundary, so neighbouring gaps depend on each other,
and the posterior of each gap comes from the forward-backward algorithm over (no boundary, boundary). Marks are not used at
all: what has none (transcripts, chats, unpunctuated scripts) is divided as well as the words themselves allow.

The counts are exact rows (key, n) on the cluster; distinct runs of words are joined with the counts that they ask for.
"""

from __future__ import annotations

import re
from collections import Counter
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.runtime import cut, drop, lookup

#: The boundary token, as an event and as a history.
B = "\x02"
#: Words of a run, and words of its neighbours on each side that are looked at with it.
SPAN, BESIDE = 200, 16
#: Words that a unit without an end mark needs to be divided.
LEAST = 4
#: Entries of a task's partial counts, after which they are handed on.
FLUSH = 200_000

#: Scripts written without spaces.
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(f"[{_UNSPACED}][̀-ͯัิ-ฺ็-๎]*|[^\\W_](?:[^\\s{_UNSPACED}]*[^\\W_])?")
_DIGITS = re.compile(r"\d+")


def words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words of a text; digits as one 0."""
    return [(_DIGITS.sub("0", m.group().casefold()), *m.span()) for m in _WORD.finditer(text)]


def event_keys(run: list[str]):
    """Keys of a sentence's n-grams with a boundary before and behind it: 1 for words, 2 for pairs, 3 for triples."""
    line = [B, *run, B]
    yield from ("1" + w for w in line[1:])
    yield from (f"2{u}\t{w}" for u, w in zip(line, line[1:]))
    yield from (f"3{t}\t{u}\t{w}" for t, u, w in zip(line, line[1:], line[2:]))


class Words:
    """Probabilities from counts by key: n-grams, and D: how many different words follow a history."""

    def __init__(self, counts, total: float, distinct: float):
        self.get, self.total, self.distinct = counts.get, max(total, 1.0), max(distinct, 1.0)

    def one(self, w: str) -> float:
        return (self.get("1" + w, 0.0) + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def _more(self, key: str, history: str, n: float, w: str, lower: float) -> float:
        different = self.get(history, 0.0)
        return (self.get(f"{key}\t{w}", 0.0) + different * lower) / (n + different) if n and different else lower

    def two(self, u: str, w: str) -> float:
        return self._more("2" + u, "D2" + u, self.get("1" + u, 0.0), w, self.one(w))

    def three(self, t: str, u: str, w: str) -> float:
        return self._more(f"3{t}\t{u}", f"D3{t}\t{u}", self.get(f"2{t}\t{u}", 0.0), w, self.two(u, w))

    def posteriors(self, run: list[str]) -> list[float]:
        """Probability of a boundary in each gap of a run that begins with a sentence."""
        steps, forward, a = [], [], [1.0, 0.0]
        for k in range(len(run) - 1):
            before, u, w = run[k - 1] if k else B, run[k], run[k + 1]
            start = self.two(B, w)
            step = [(self.three(h, u, w), self.three(h, u, B) * start) for h in (before, B)]
            a = [a[0] * step[0][e] + a[1] * step[1][e] for e in (0, 1)]
            total = sum(a) or 1.0
            a = [x / total for x in a]
            steps.append(step)
            forward.append(a)
        back = [self.three(run[-2], run[-1], B), self.three(B, run[-1], B)] if len(run) > 1 else []
        out = [0.0] * len(steps)
        for k in range(len(steps) - 1, -1, -1):
            n, b = (forward[k][e] * back[e] for e in (0, 1))
            out[k] = b / ((n + b) or 1.0)
            back = [sum(steps[k][f][e] * back[e] for e in (0, 1)) for f in (0, 1)]
            total = sum(back) or 1.0
            back = [x / total for x in back]
        return out


def runs(found: list[str]) -> list[tuple[int, int, list[str]]]:
    """(first gap, last gap + 1, words) of a unit's words in runs of bounded size, with words beside them."""
    out = []
    for k in range(0, len(found) - 1, SPAN):
        last = min(k + SPAN, len(found) - 1)
        begin = max(0, k - BESIDE)
        out.append((begin, k - begin, last - begin, found[begin : last + 1 + BESIDE]))
    return [(a, (lo, hi), w) for a, lo, hi, w in out]


def count(sentences: DataFrame) -> DataFrame:
    """The model's counts (key, n) from sentences (words array<string>)."""

    def run(batches):
        import pyarrow as pa

        keys: Counter = Counter()

        def out():
            x = pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string()), pa.array([float(n) for n in keys.values()], pa.float64())], names=["key", "n"])
            keys.clear()
            return x

        for b in _slices(batches):
            for found in b.column("words").to_pylist():
                keys.update(event_keys(found))
                if len(keys) > FLUSH:
                    yield out()
        yield out()

    events = cut(sentences.select("words").mapInArrow(run, "key string, n double").groupBy("key").agg(F.sum("n").alias("n")))
    longer = events.where(F.substring("key", 1, 1).isin("2", "3"))
    followed = longer.groupBy(F.concat(F.lit("D"), F.regexp_extract("key", "^(.*)\t[^\t]*$", 1)).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    words_of = events.where(F.col("key").startswith("1"))
    whole = words_of.agg(F.lit("N").alias("key"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).unionByName(words_of.agg(F.lit("V").alias("key"), F.count(F.lit(1)).cast("double").alias("n")))
    return cut(events.unionByName(followed).unionByName(whole))


def _slices(batches, rows: int = 500):
    """The batches in parts, so that few rows with long lists are Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


class _Asked(dict):
    def get(self, key, default=None):
        self[key] = None
        return 1.0  # so that all that could be asked for is


def _ask(batches):
    import pyarrow as pa

    for b in _slices(batches):
        ids, keys = [], []
        for i, run in zip(b.column("run_id").to_pylist(), b.column("run").to_pylist(), strict=True):
            asked = _Asked()
            Words(asked, 1.0, 1.0).posteriors(run)
            ids += [i] * len(asked)
            keys += asked
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.string())], names=["run_id", "key"])


def _decide(total: float, distinct: float):
    def go(batches):
        import pyarrow as pa

        for b in _slices(batches):
            ids, ends = [], []
            for i, run, keys, counts in zip(*(b.column(c).to_pylist() for c in ("run_id", "run", "keys", "counts")), strict=True):
                ids.append(i)
                ends.append("".join("01"[p >= 0.5] for p in Words(dict(zip(keys or (), counts or (), strict=True)), total, distinct).posteriors(run)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, ends)], names=["run_id", "ends"])

    return go


def decided(asked_runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run_id, ends): for each gap of a run (run_id, run array<string>), 1 for a boundary, else 0."""
    whole = {r.key: r.n for r in counts.where("key in ('N', 'V')").collect()}
    asked = cut(asked_runs.mapInArrow(_ask, "run_id string, key string"))
    got = lookup(asked, "key", counts, "key", "n", "n", asked.n_rows)
    got = got.groupBy("run_id").agg(F.collect_list(F.struct("key", "n")).alias("c")).select(F.col("run_id").alias("__r"), F.col("c.key").alias("keys"), F.col("c.n").alias("counts"))
    x = asked_runs.join(got, F.col("run_id") == F.col("__r"), "left").drop("__r")
    return x.mapInArrow(_decide(whole.get("N", 0.0), whole.get("V", 0.0)), "run_id string, ends string")


_UNITS = "doc_id bigint, unit string, start_pos bigint, end_pos bigint, marked boolean, words array<string>, begins array<int>, stops array<int>"


def _worded(ends: frozenset):
    """Units (doc_id, text, starts, ends) as rows with their words and places."""

    def go(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in _UNITS.split(", ")]
        task, made, rows = uuid4().hex, 0, []

        def out():
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            for doc, text, starts, stops in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "starts", "ends")), strict=True):
                for a, e in zip(starts, stops, strict=True):
                    made += 1
                    found = words(text[a:e])
                    rows.append((doc, f"{task}{made:x}", a, e, text[e - 1] in ends, [w for w, *_ in found], [a + i for _, i, _ in found], [a + j for *_, j in found]))
                if len(rows) > 10_000:
                    yield out()
        yield out()

    return go


def _parted(batches):
    """The pieces of units by the decisions on their runs."""
    import pyarrow as pa

    for b in batches:
        out = []
        for doc, a, e, begins, stops, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start_pos", "end_pos", "begins", "stops", "parts")), strict=True):
            at = a
            for p in sorted(parts or (), key=lambda p: p["first"]):
                for k in range(p["lo"], p["hi"]):
                    if p["ends"][k] == "1":
                        gap = p["first"] + k
                        out.append((doc, at, stops[gap]))
                        at = begins[gap + 1]
            out.append((doc, at, e))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start_pos", "end_pos"])


def _runs(batches):
    import pyarrow as pa

    names, kinds = ["unit", "first", "lo", "hi", "run"], [pa.string(), *[pa.int32()] * 3, pa.list_(pa.string())]
    for b in batches:
        out = [(u, first, lo, hi, run) for u, found in zip(b.column("unit").to_pylist(), b.column("words").to_pylist(), strict=True) for first, (lo, hi), run in runs(found)]
        cols = list(zip(*out, strict=True)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def divided(texts: DataFrame, ends: frozenset, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos): the units of texts (doc_id, text, starts, ends), those without an end mark divided by the model.

    Without counts, they come from the units with a mark. Blanks and marks between the words at a boundary belong to the
    unit before if they touch its last word, else to the next.
    """
    units = cut(texts.select("doc_id", "text", "starts", "ends").mapInArrow(_worded(ends), _UNITS))
    if counts is None:
        counts = count(units.where(F.col("marked") & (F.size("words") > 0)))
    open_units = ~F.col("marked") & (F.size("words") >= LEAST)
    parts = cut(units.where(open_units).select("unit", "words").mapInArrow(_runs, "unit string, first int, lo int, hi int, run array<string>").withColumn("run_id", F.md5(F.array_join("run", "\t"))))
    distinct = parts.groupBy("run_id").agg(F.first("run").alias("run"))
    found = cut(decided(cut(distinct), counts))
    got = lookup(parts.select("unit", "first", "lo", "hi", "run_id"), "run_id", found, "run_id", "ends", "ends", parts.n_rows)
    got = got.where(F.instr("ends", "1") > 0).groupBy(F.col("unit").alias("__u")).agg(F.collect_list(F.struct("first", "lo", "hi", "ends")).alias("parts"))
    x = units.where(open_units).join(got, F.col("unit") == F.col("__u"))
    whole = units.join(got.select("__u"), F.col("unit") == F.col("__u"), "left_anti").select("doc_id", "start_pos", "end_pos")
    return whole.unionByName(x.select("doc_id", "start_pos", "end_pos", "begins", "stops", "parts").mapInArrow(_parted, "doc_id bigint, start_pos bigint, end_pos bigint"))
