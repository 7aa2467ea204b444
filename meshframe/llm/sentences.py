"""Sentence boundaries across languages and scripts: a hidden-event n-gram language model.

A text's blocks (see blocks.py) bound its units. Inside a block, boundary tokens are hidden events in the gaps between
words. Most gaps are decided by what the text is made of: no end mark, no boundary; an end mark of a script that uses it
for nothing else, a boundary; within a quotation or parenthesis, none; in Thai, a blank between letters. In all other gaps
(after a full stop, an ellipsis, a closing quote, a mark in a name) the model decides: the probability that the left word
ends a sentence, times that of the right word and the one after it given a boundary or given the left word. Neighbouring gaps
depend on each other (a word's history ends at a boundary), so posteriors come from the forward-backward algorithm.

Training needs no labels. Starts and ends of blocks show how sentences begin and end; gaps without an end mark show how
they go on; expectation-maximization over all open gaps of the corpus does the rest. Counts are exact at every size: they
are rows (key, n) on the cluster, and runs of open gaps are joined with the counts of the keys that they ask for. Only the
counts of the FIXED keys, whose number doesn't depend on the texts, are collected and sent to the tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache
from hashlib import blake2b
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm.arrow import lists
from meshframe.llm.blocks import blocks
from meshframe.llm.unmarked import divided
from meshframe.runtime import cut, drop, lookup

ROUNDS = 4
#: Characters of a word, beyond which its middle is known by a digest.
LONG = 48
#: Entries of a task's partial counts, after which they are handed on.
FLUSH = 200_000
#: Weights of the back-off distributions.
K_WORD, K_PAIR, K_EVENT, K_CLASS = 2.0, 3.0, 4.0, 0.05
RARE = 1e-4
#: Share of words that are new to a distribution; the same for all, else small ones would attract new words.
NEW = 0.001

#: Marks that end a sentence wherever they stand, marks that may, and what can close behind a mark.
SURE = "。！？｡؟።፧।॥۔"
OPEN_MARKS = ".!?…‼⁇⁈⁉"
CLOSERS = "\"'”’»›)\\]）」』】》〉*_~“"
_BEFORE_WHOLE = frozenset(SURE + OPEN_MARKS + CLOSERS.replace("\\", ""))
ENDS = frozenset(SURE + OPEN_MARKS + CLOSERS.replace("\\", "") + ";")
PAIRS = {"“": "”", "‘": "’", "«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "»": "«"}

_MASK = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)|https?://[^\s<>`\"'”“«»「」（）。，、！？；؟।።፧]+", re.S)
_MARK = re.compile(f"[{re.escape(SURE + OPEN_MARKS)};;]+")
_CLOSE = re.compile(f"[{CLOSERS}]+|[\\s]+»")
_QUOTES = re.compile("[“”‘’«»„「」『』()（）\\[\\]【】《》\"']")
_SPACE = re.compile(r"\s*")
_TOKEN = re.compile(r"\S+")
_THAI = re.compile(r"(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])")
_GREEK = re.compile("[Ͱ-ͽͿ-Ͽἀ-῿]")
_CODES, _URLS = re.compile("\ue000+"), re.compile("\ue001+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_AFTER = re.compile(r"[.!?](?<=[^\W\d_]{4}.)\s+([^\W\d_])", re.S)
_DIGITS = re.compile(r"\d+")
_FRONT = re.compile("^[\"'“”‘’«»„「」『』(（\\[【《*_~¿¡]+")
_BACK = re.compile("[\"'“”‘’«»„「」『』)）\\]】》*_~.,;:!?…。，、！？；：]+$")
_NO_SPACES = re.compile("[⺀-ヿ㐀-䶿一-鿿豈-﫿＀-￯]")
_WORDLIKE = re.compile(r"[^\W\d_]")
CASELESS = "\x08"
#: Totals, opening marks and classes of right words, classes of left words: keys that most gaps ask for.
FIXED = [k + x for k in "SZWR" for x in ("", "\x0f", '\x0f"', "\x0f(", "\x0f¿", *("\x01" + c for c in "ACl0xop"))]
FIXED += [k + "\x06\x03" + m + c for k in "EO" for m in ".…!m" for c in (*"x0p1dAClo", "As", "Cs", "ls", "os")]
CODE, URL = "", ""


def _mask(text: str) -> str:
    """Inline code and addresses become runs of one letter each; lengths stay."""

    def by(m: re.Match) -> str:
        s = m.group()
        if s[0] == "`":
            return CODE * len(s)
        tail = len(s) - len(s.rstrip(".,;:!?)'*_~]"))
        return URL * (len(s) - tail) + s[len(s) - tail :]

    return _MASK.sub(by, text) if "`" in text or "://" in text else text


def _enclosures(s: str) -> list[tuple[int, int]]:
    """Matched quotations and parentheses (open, close) of a block; marks without a partner enclose nothing."""
    out, stack, places = [], [], defaultdict(list)  # places: by closing mark, where in the stack it has a partner

    def opens(i: int, closers: str) -> None:
        for x in closers:
            places[x].append(len(stack))
        stack.append((i, closers))

    def close(k: int, i: int) -> None:
        out.append((stack[k][0], i))
        while len(stack) > k:
            for x in stack.pop()[1]:
                places[x].pop()

    for m in _QUOTES.finditer(s):
        c, i = m.group(), m.start()
        before, after = s[i - 1 : i], s[i + 1 : i + 2]
        closes = places[c][-1] if places[c] else None
        if c in "\"'":
            opening = (not before or before.isspace() or before in "([（“„«¿¡—*_-") and after and not after.isspace()
            if c == "'" and not (opening and (after.isalnum() or after in "\"¿¡" + CODE)) and (closes is None or after.isalnum() or before.isspace()):
                continue
            if closes is not None and not (opening and c == "'" and False) and not (before.isspace() and opening):
                close(closes, i)
            elif opening or (closes is None and _NO_SPACES.match(after)):
                opens(i, c)
        elif closes is not None:
            close(closes, i)
        elif c in PAIRS and c not in "’”" and not (c == "»" and before and not before.isspace()):
            opens(i, PAIRS[c])
    return out


def _norm(token: str) -> str:
    """A word as the model knows it: digits as one 0, code and addresses as one letter, the middle of one longer than LONG as a digest of it."""
    if len(token) <= LONG:
        return _norm_short(token)
    x = _normed(token)
    if len(x) <= LONG:
        return x
    digest = blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return x[: LONG // 4] + "".join(chr(0xF100 + d) for d in digest) + x[-LONG // 4 :]  # letters of no case or script


def _normed(token: str) -> str:
    if token.isalpha():
        return token
    x = _DIGITS.sub("0", _INVISIBLE.sub("", token))
    return _URLS.sub(URL, _CODES.sub(CODE, x)) if CODE in x or URL in x else x


@lru_cache(1 << 16)
def _norm_short(token: str) -> str:
    return _normed(token)


def _vague(token: str) -> bool:
    """Numbers, code, addresses and file names say little: the word behind them is looked at as well."""
    return not token.isalpha() and (not _WORDLIKE.search(token) or CODE in token or URL in token or "." in token[:-1] or any(c.isdigit() for c in token))


def _cached_short(f):
    """f of a token, kept if it is short."""
    kept = lru_cache(1 << 16)(f)
    return lambda token: kept(token) if len(token) <= LONG else f(token)


@_cached_short
def _right_of(raw: str) -> tuple[str, str, str | None]:
    """What opens before a token, the word in it, and what of an unspaced script follows in it; None: the next token may."""
    front = _FRONT.match(raw)
    word = raw[front.end() :] if front else raw
    mark = ""
    if front:
        mark = "(" if front.group()[0] in "(（[" else "¿" if front.group()[-1] in "¿¡" else "" if front.group()[0] in "*_~" else '"'
    if not word:
        return mark, raw[:2], ""
    if _NO_SPACES.match(word) or "\u0e00" <= word[0] < "\u0e80":
        return mark, word[:2], ""
    follows = ""
    if cjk := _NO_SPACES.search(word):
        word, follows = word[: cjk.start()], word[cjk.start() : cjk.start() + 2]
    word = _norm(_BACK.sub("", word) or word)
    if not _vague(word):
        return mark, word, ""
    return mark, ("F" if "." in word and _WORDLIKE.search(word) and CODE not in word and URL not in word else word) + " ", follows or None


@_cached_short
def _following(raw: str) -> str:
    """The word of the token behind a vague one."""
    follows = _FRONT.sub("", raw)
    follows = follows[:2] if _NO_SPACES.match(follows) else _norm(_BACK.sub("", follows))
    if cjk := _NO_SPACES.search(follows):
        follows = follows[: cjk.start() + 1]
    return follows


def right_word(s: str, i: int) -> str:
    """The word at i as the model knows it; in scripts without spaces, its first two characters."""
    m = _TOKEN.match(s, i)
    if not m:
        return ""
    mark, word, follows = _right_of(m.group())
    if follows is None:
        nxt = _TOKEN.match(s, _SPACE.match(s, m.end()).end())
        follows = _following(nxt.group()) if nxt else ""
    return mark + word + follows


def _opener(word: str) -> tuple[str, str]:
    """What opens before a right word, and the word alone."""
    return (word[0], word[1:]) if word[:1] in ('"', "(", "¿") and len(word) > 1 else ("", word)


def shape(w: str) -> str:
    """Class of a right word."""
    c = w[:1]
    kind = "A" if len(w) > 1 and w.isupper() and w.isalpha() else "C" if c.isupper() else "l" if c.islower() else "0" if c.isdigit() else "x" if c in (CODE, URL) else "o" if c.isalpha() else "p"
    return "\x01" + kind


def left_class(left: str) -> str:
    """Class of a left word with its mark."""
    if left[0] == "\x02":
        return left
    body = left.rstrip(OPEN_MARKS + SURE)
    mark = left[len(body) :]
    mark = "." if mark == "." else "…" if mark.startswith(("..", "…")) else "!" if set(mark) <= set("!?‼⁇⁈⁉") else "m"
    letters = [c for c in body if c.isalpha()]
    kind = "x" if CODE in body or URL in body else "0" if body[-1:].isdigit() else "p" if not letters else "1" if len(letters) == 1 else "d" if "." in body else ("A" if len(letters) > 3 and body.isupper() else "C" if letters[0].isupper() else "l" if letters[0].islower() else "o") + ("s" if len(body) < 5 else "")
    return "\x03" + mark + kind


class Inside:
    """Enclosures of a block: which marks open or close one, and whether a position lies inside of any."""

    __slots__ = ("opens", "partner", "begins", "ends")

    def __init__(self, found: list[tuple[int, int]]):
        self.opens = {a for a, _ in found}
        self.partner = {b: a for a, b in found}
        self.begins: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(found):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.begins.append(a)
                self.ends.append(b)

    def __contains__(self, i: int) -> bool:
        k = bisect_left(self.begins, i) - 1
        return k >= 0 and i <= self.ends[k]


class Gaps:
    """Gaps of one block: units' ends that are certain, and runs of open gaps.

    sure: positions. runs: (first, [(position, left, right), ...]): neighbouring open gaps, `first` tells whether the left
    word begins its sentence. end: (first, left) if the block ends with a mark. starts: right words of certain starts.
    masked: the block's text behind its marker.
    """

    __slots__ = ("sure", "runs", "end", "starts", "caseless", "masked", "tokens")

    def __init__(self, text: str, start: int, end: int, word: int, lowered: bool):
        self.sure: list[int] = []
        self.runs: list[tuple[bool, list[tuple[int, str, str]]]] = []
        self.end: tuple[bool, str] | None = None
        s = self.masked = _mask(text[word:end])
        base = word
        self.caseless = lowered or s.islower() or s.isupper()
        self.starts = [x] if (x := self._right(s, 0)) else []
        marks = list(_MARK.finditer(s))
        thai = [m.end() for m in _THAI.finditer(s)]
        if not marks and not thai:
            return
        size = len(s.rstrip())
        inside = Inside(_enclosures(s) if _QUOTES.search(s) else [])
        self.tokens = [m.start() for m in _TOKEN.finditer(s)]
        greek = [m.start() for m in _GREEK.finditer(s)]
        for i in thai:
            if i not in inside:
                self.sure.append(base + i)
        previous = -1  # where the word to the right of the last open gap begins
        begin = 0  # where the last certain sentence begins
        since, upto = 0, 0  # where what stands behind the last mark begins
        for m in marks:
            i, j = m.span()
            since, upto = upto, j
            mark = m.group()
            if i < begin:
                continue
            if ";" in mark or ";" in mark:
                if mark.strip(";;") == "" and (mark[0] == ";" or not _mostly(greek, s, max(begin, since), i) or s[j : j + 1].isalnum()):
                    continue
            closed = False
            while c := _CLOSE.match(s, j):
                k = c.end()
                if s[k - 1] == "“" and k - 1 not in inside.partner:
                    k = c.start() + len(c.group()) - 1
                for x in range(c.start(), k):  # an opening mark closes nothing
                    if s[x] in "\"'*_" and s[x - 1 : x].isspace() or x in inside.opens:
                        k = x
                        break
                if s[j : j + 1].isspace() and k - 1 not in inside.partner:
                    break
                if k <= j:
                    break
                closed = closed or s[j:k].strip("*_~") != ""
                j = k
            if j in inside:
                continue
            nxt = s[j : j + 1]
            if j >= size:
                self.end = (self._first(s, i, begin), self._left(s, i, j, m, closed, inside))
                continue
            blank = nxt.isspace()
            if not blank:
                if nxt in ",;:，、；：/\\=|)]}）」』】-–—%&@#+<^" or nxt.isdigit() and not closed and mark[-1] not in SURE:
                    continue
                if mark[-1] not in SURE and not closed and mark[0] not in "…‼⁇⁈⁉":
                    if nxt.islower() or mark[0] == "." and nxt in "'\"" and not s[j + 1 : j + 2].isalpha():
                        continue
                    if not (nxt.isalpha() or nxt in "\"'“„«(¿¡「（*_" or nxt == CODE) or nxt in "ºª":
                        continue
            at = _SPACE.match(s, j).end()
            if mark[-1] in SURE and not closed or ";" in mark or ";" in mark:
                self.sure.append(base + at)
                begin = at
                if x := self._right(s, at):
                    self.starts.append(x)
                continue
            left_at = self._left_at(s, i)
            gap = (base + at, self._left(s, i, j, m, closed, inside), self._right(s, at))
            if previous >= 0 and left_at <= previous < i:
                self.runs[-1][1].append(gap)
            else:
                self.runs.append((self._first(s, i, begin), [gap]))
            previous = at
        self.sure.sort()

    def _right(self, s: str, i: int) -> str:
        """In a block that is all in one case, case says nothing about the word."""
        word = right_word(s, i)
        return CASELESS + word.casefold() if self.caseless and word else word

    def _left_at(self, s: str, i: int) -> int:
        """Where the word begins that a mark at i is part of or begins; in scripts without spaces, two characters before."""
        k = self.tokens[bisect_right(self.tokens, i) - 1]
        return max(k, i - 2) if i > k and _NO_SPACES.match(s, i - 1) else k

    def _first(self, s: str, i: int, begin: int) -> bool:
        return self._left_at(s, i) <= begin

    def _left(self, s: str, i: int, j: int, m: re.Match, closed: bool, inside: Inside) -> str:
        if closed:
            opened = max((inside.partner[b] for b in range(i + 1, j) if b in inside.partner), default=-1)
            k = opened - 1
            while k >= 0 and s[k].isspace():
                k -= 1
            before = s[k] if k >= 0 else ""
            whole = opened >= 0 and (not before or before in _BEFORE_WHOLE)
            return "\x02" + m.group()[-1] + s[j - 1] + ("w" if whole else "p" if before and before in ":：" else "")
        if _NO_SPACES.match(s, i - 1):
            return "\x02" + m.group()[-1]
        word = _left_word(s[self._left_at(s, i) : i]) + m.group()[:24]  # many marks are as good as more
        return word.casefold() if self.caseless else word


@_cached_short
def _left_word(raw: str) -> str:
    return _norm(_FRONT.sub("", raw) or raw)


def _mostly(greek: list[int], s: str, begin: int, end: int) -> bool:
    """Are Greek letters at least as many as Latin ones in s[begin:end]?"""
    n = bisect_left(greek, end) - bisect_left(greek, begin)
    return n > 0 and n >= sum(c.isalpha() for c in s[begin:end] if c.isascii())


def gaps(text: str) -> list[tuple[int, int, Gaps]]:
    """(start, end, gaps) of each block.

    Where most paragraphs (blocks without a marker that end with a mark), and what follows end marks in them, begin in lower
    case, case says nothing about the words of paragraphs.
    """
    found, lower, upper = blocks(text), 0, 0
    plain = [not text[start:word].strip() for start, _, word in found]
    for (_, end, word), p in zip(found, plain, strict=True):
        if not p or text[word:end].rstrip()[-1:] not in ENDS:
            continue
        first = _TOKEN.match(text, word, end).group()
        if len(first) > 1 and first[0].isalpha() and not _vague(first):  # a single letter may be upper case of its own
            lower += first[0].islower()
            upper += first[0].isupper()
        for c in _AFTER.findall(text, word, end):
            lower += c.islower()
            upper += c.isupper()
    return [(start, end, Gaps(text, start, end, word, p and lower > upper)) for (start, end, word), p in zip(found, plain, strict=True)]


def _event_keys(first: bool, left: str) -> tuple[str, str, str]:
    return f"\x04{int(first)}{left}", f"\x05{left.casefold()}", f"\x06{left_class(left)}"


def _likely(share: float) -> float:
    """Words end sentences or they don't: shares well above none count as ends."""
    return share * share / (share * share + 0.0144)


class Model:
    """Probabilities from counts: a mapping, or a DataFrame (key, n), which is collected (for small tables, on a driver).

    Keys: S start, Z start of a block, W inside, R right of an open gap, P pair, L left word of pairs, E block end, O open gap.
    """

    def __init__(self, table: Mapping[str, float] | DataFrame):
        self.table = table
        self.counts = {r.key: r.n for r in table.select("key", "n").toLocalIterator()} if isinstance(table, DataFrame) else table
        self.starts, self.inside = max(self.n("S"), 1.0), max(self.n("W"), 1.0)
        self.rights = max(self.n("R"), 1.0)
        ends, opens = self.n("E\x06\x03.l"), self.n("O\x06\x03.l")
        self.odds = (opens + 1) / (ends + 1)  # open gaps a block end, after ordinary words
        self.known: dict[tuple, float] = {}

    def n(self, key: str) -> float:
        return self.counts.get(key, 0.0)

    def _word(self, kind: str, total: float, word: str) -> float:
        caseless, (front, word) = word[:1] == CASELESS, _opener(word.lstrip(CASELESS))
        opened = (self.n(kind + "\x0f" + front) + 0.1) / (total + 1)
        p = (self.n(kind + shape(word)) + 0.1) / (total + 1) * RARE
        k = K_WORD + NEW * total
        p = (self.n(kind + "\x07" + word.casefold()) + k * p) / (total + k)
        return opened * (p if caseless else (self.n(kind + word) + k * p) / (total + k))

    def _inside(self, word: str) -> float:
        """Probability of a right word without a boundary: as inside of sentences, or as in open gaps that block starts don't explain."""
        plain = self._word("W", self.inside, word)
        front, w = _opener(word.lstrip(CASELESS))
        key = "\x07" + w if word[:1] == CASELESS else w
        rest = max(0.0, self.n("R" + key) - 2 * self.odds * self.n("Z" + key))
        opened = (self.n("R\x0f" + front) + 0.1) / (self.rights + 1)
        return 0.5 * plain + 0.5 * opened * (rest + K_WORD * plain) / (self.rights + K_WORD)

    def ends(self, first: bool, left: str) -> float:
        """Probability that the left word ends a sentence: its block ends tell how many of its open gaps should be ends."""
        p, of_class = 0.5, 0.5
        for key, k in zip(reversed(_event_keys(first, left)), (1.0, K_EVENT, K_EVENT), strict=True):
            n = self.n("O" + key)
            p = min(1.0, (min(self.n("E" + key) * self.odds, n) + k * p) / (n + k))
            of_class = p if k == 1.0 else of_class
        return min(max((1 - K_CLASS) * _likely(p) + K_CLASS * _likely(of_class), 1e-4), 1 - 1e-4)

    def weights(self, first: bool, left: str, right: str) -> tuple[float, float]:
        """Joint probabilities of the right word with no boundary and with one."""
        key = (first, left, right)
        if (w := self.known.get(key)) is None:
            b = self.ends(first, left)
            inside = (self.n(f"P{left}\t{right}") + K_PAIR * self._inside(right)) / (self.n("L" + left) + K_PAIR)
            w = self.known[key] = ((1 - b) * inside, b * self._word("S", self.starts, right))
            if len(self.known) > 200_000:
                self.known.clear()
        return w

    def posteriors(self, first: bool, run: list[tuple[str, str]]) -> list[float]:
        """Probability of a boundary in each gap of a run, by forward-backward over (no boundary, boundary)."""
        if len(run) == 1:
            n, b = self.weights(first, *run[0])
            return [b / (n + b)]
        forward, steps = [], []
        for k, (left, right) in enumerate(run):
            w = [self.weights(f, left, right) for f in (False, True)]
            steps.append(w)
            if k == 0:
                a = list(w[first])
            else:
                p = forward[-1]
                a = [p[0] * w[0][e] + p[1] * w[1][e] for e in (0, 1)]
            total = sum(a) or 1.0
            forward.append([x / total for x in a])
        back, out = [1.0, 1.0], [0.0] * len(run)
        for k in range(len(run) - 1, -1, -1):
            n, b = (forward[k][e] * back[e] for e in (0, 1))
            out[k] = b / ((n + b) or 1.0)
            back = [sum(steps[k][f][e] * back[e] for e in (0, 1)) for f in (0, 1)]
            total = sum(back) or 1.0
            back = [x / total for x in back]
        return out


def _word_keys(kind: str, word: str) -> tuple[str, ...]:
    if word[:1] == CASELESS:
        front, word = _opener(word[1:])
        return kind, kind + "\x0f" + front, kind + "\x07" + word
    front, word = _opener(word)
    return kind, kind + "\x0f" + front, kind + word, kind + "\x07" + word.casefold(), kind + shape(word)


def _inside_word(token: str) -> str:
    """A token of a masked text as right_word gives it: what opens before it, and the word."""
    front = '"' if token[0] in "\"'“„«" else "(" if token[0] in "([" else ""
    word = _FRONT.sub("", token) or token
    if _NO_SPACES.match(word) or "฀" <= word[0] < "຀":
        return front + word[:2]
    if cjk := _NO_SPACES.search(word):
        word = word[: cjk.start()]
    return front + _norm(_BACK.sub("", word) or word)


_PARSED = "key string, n double, row_id string, doc_id bigint, text string, pieces array<int>, runs array<string>"


def _pieces(text: str, found: list[tuple[int, int, Gaps]]) -> tuple[list[int], list[str]]:
    """What lies between possible ends, as (start, end, run, place) in one list, and runs by their words.

    Pieces are trimmed; start and end are equal for blank ones. A piece begins at an open gap of a run, or, with run -1, at a certain end.
    """
    pieces, runs = [], []
    for start, end, g in found:
        at = [(start, -1, -1), *((e, -1, -1) for e in g.sure)]
        for first, run in g.runs:
            at += [(gap[0], len(runs), k) for k, gap in enumerate(run)]
            runs.append("\x1f".join([str(int(first)), *(x for gap in run for x in gap[1:])]))
        at.sort()
        for (a, run, k), (e, *_) in zip(at, [*at[1:], (end,)], strict=True):
            part = text[a:e]
            bare = part.strip()
            if part[:1].isspace() and bare:
                a += len(part) - len(part.lstrip())
            pieces += (a, a + len(bare), run, k)
    return pieces, runs


def _parser(keep: bool):
    """_parse, with the texts themselves if they are to be kept."""
    return lambda batches: _parse(batches, keep)


def _parse(batches, keep: bool = False):
    """Counts of certain events by key, and each text's pieces and open runs."""
    import pyarrow as pa

    task, n_texts = uuid4().hex, 0
    inside, seen, rights, kinds = Counter(), Counter(), Counter(), Counter()
    kind = pa.schema([("key", pa.string()), ("n", pa.float64()), ("row_id", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), ("pieces", pa.list_(pa.int32())), ("runs", pa.list_(pa.string()))])

    def counted():
        keys = Counter()
        for word, n in inside.items():
            for key in _word_keys("W", _inside_word(word)) if word else ():
                keys[key] += n
        for what, words in (("S", seen), ("Z", seen), ("R", rights)):
            for x, n in words.items():
                for key in _word_keys(what, x):
                    keys[key] += n
        for (what, first, left), n in kinds.items():
            for key in _event_keys(first, left):
                keys[what + key] += n
        for x in (inside, seen, rights, kinds):
            x.clear()
        none = [None] * len(keys)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([list(keys), list(keys.values()), *[none] * 5], kind.types, strict=True)], schema=kind)

    for b in batches:
        ids, docs, texts, pieces, runs = [], [], [], [], []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = gaps(text)
            for start, end, g in found:
                inside.update(text[start : end - len(g.masked)].split())
                inside.update(g.masked.split())
                for x in g.starts:
                    seen[x] += 1
                    inside[_opener(x.lstrip(CASELESS))[1].split(" ")[0]] -= 1
                if g.end:
                    kinds[("E", *g.end)] += 1
                for first, run in g.runs:
                    for k, (_, left, right) in enumerate(run):
                        kinds[("O", first and k == 0, left)] += 1
                        inside[_opener(right.lstrip(CASELESS))[1].split(" ")[0]] -= 1
                        rights[right] += 1
            cut_up, open_runs = _pieces(text, found)
            n_texts += 1
            ids.append(f"{task}{n_texts:x}")
            docs.append(doc)
            texts.append(text if keep else None)
            pieces.append(cut_up)
            runs.append(open_runs)
            if len(inside) + len(seen) + len(rights) + len(kinds) > FLUSH:
                yield counted()
        none = [None] * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([none, none, ids, docs, texts, pieces, runs], kind.types, strict=True)], schema=kind)
    yield counted()


def _split(run: str) -> tuple[bool, list[tuple[str, str]]]:
    first, *words = run.split("\x1f")
    return first == "1", list(zip(words[::2], words[1::2], strict=True))


class _Asked(dict):
    """Counts that note which keys are asked for."""

    def get(self, key, default=None):
        self[key] = None
        return default


def _ask(batches):
    """The keys but FIXED that the model asks for in each run."""
    import pyarrow as pa

    fixed = set(FIXED)
    for b in batches:
        ids, keys = [], []
        for i, run in zip(b.column("run_id").to_pylist(), b.column("run").to_pylist(), strict=True):
            model = Model({})
            model.counts = _Asked()
            model.posteriors(*_split(run))
            asked = [k for k in model.counts if k not in fixed]
            ids += [i] * len(asked)
            keys += asked
            if len(keys) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.string())], names=["run_id", "key"])
                ids, keys = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.string())], names=["run_id", "key"])


def _judged(batch, model: Model, fixed: dict[str, float]) -> Iterator[tuple]:
    """(run_id, n, gaps, posteriors) of runs with their counts."""
    columns = [batch.column(c).to_pylist() for c in ("run_id", "run", "n", "keys", "counts")]
    for i, run, n, keys, counts in zip(*columns, strict=True):
        model.counts = {**fixed, **dict(zip(keys or (), counts or (), strict=True))}
        first, gaps = _split(run)
        yield i, n, gaps, model.posteriors(first, gaps)


def _expect(fixed: dict[str, float]):
    """Expected counts of open runs under the model so far."""

    def run(batches):
        import pyarrow as pa

        model, sums = Model(fixed), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], names=["key", "n"])

        for b in batches:
            for _, n, gaps, found in _judged(b, model, fixed):
                for (left, right), p in zip(gaps, found, strict=True):
                    for key in _word_keys("S", right):
                        sums[key] += n * p
                    if p < 0.5:  # a pair is learnt from gaps that are rather none, else it would confirm itself
                        sums[f"P{left}\t{right}"] += n * (1 - p)
                        sums["L" + left] += n * (1 - p)
                if len(sums) > FLUSH:
                    yield out()
                    sums.clear()
        yield out()

    return run


def _decide(fixed: dict[str, float]):
    """Of each run, a 1 for every gap that is a boundary, else a 0."""

    def run(batches):
        import pyarrow as pa

        model = Model(fixed)
        for b in batches:
            found = [(i, "".join("01"[p >= 0.5] for p in ps)) for i, _, _, ps in _judged(b, model, fixed)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["run_id", "ends"])

    return run


def _units(pieces: list[int], at: list[int] | None, found: list[str] | None) -> Iterator[tuple[int, int]]:
    """Units of a text from its pieces and the decisions on its runs."""
    decided, begin, last = dict(zip(at or (), found or (), strict=True)), -1, -1
    for a, e, run, k in [*zip(*[iter(pieces)] * 4, strict=True), (0, 0, -1, -1)]:
        if begin >= 0 and (run < 0 or decided[run][k] == "1"):
            yield begin, last
            begin = -1
        if a < e:
            begin, last = a if begin < 0 else begin, e


def _assemble(batches):
    import pyarrow as pa

    for b in batches:
        docs, starts, ends = [], [], []
        for doc, pieces, at, found in zip(b.column("doc_id").to_pylist(), lists(b.column("pieces")), lists(b.column("at")), b.column("ends").to_pylist(), strict=True):
            for a, e in _units(pieces, at, found):
                docs.append(doc)
                starts.append(a)
                ends.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, ends)], names=["doc_id", "start_pos", "end_pos"])


def _assemble_texts(batches):
    import pyarrow as pa

    for b in batches:
        found = [list(_units(*x)) for x in zip(lists(b.column("pieces")), lists(b.column("at")), b.column("ends").to_pylist(), strict=True)]
        ends = [pa.array([[u[k] for u in x] for x in found], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *ends], names=["doc_id", "text", "starts", "ends"])


class _Corpus:
    """Texts read once: base (key, n) counts of certain events, texts with pieces and runs, distinct runs, the keys they ask for."""

    def __init__(self, documents: DataFrame, keep: bool = False):
        parsed = cut(documents.select("doc_id", "text").where("text is not null").mapInArrow(_parser(keep), _PARSED))
        base = parsed.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
        self.base = base.where("n > 0")
        self.texts = parsed.where("row_id is not null").select("row_id", "doc_id", "text", "pieces", "runs")
        runs = self.texts.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count(F.lit(1)).cast("double").alias("n"))
        self.runs = cut(runs.select(F.md5("run").alias("run_id"), "run", "n"))
        self.asked = cut(self.runs.select("run_id", "run").mapInArrow(_ask, "run_id string, key string"))

    def wanted(self, counts: DataFrame) -> DataFrame:
        """Counts of FIXED keys and of those that runs ask for."""
        spark = counts.sparkSession
        keys = self.asked.select(F.col("key").alias("__k")).distinct().unionByName(spark.createDataFrame([(k,) for k in FIXED], "__k string"))
        return cut(counts.join(keys, F.col("key") == F.col("__k"), "left_semi").select("key", "n"))

    def judge(self, counts: DataFrame, by, schema: str) -> DataFrame:
        """What `by` of the counts of the FIXED keys makes of the runs with the counts they ask for."""
        fixed = {r.key: r.n for r in counts.where(F.col("key").isin(FIXED)).collect()}
        found = lookup(self.asked, "key", counts, "key", "n", "n", self.asked.n_rows)
        found = found.groupBy("run_id").agg(F.collect_list(F.struct("key", "n")).alias("c")).select(F.col("run_id").alias("__r"), F.col("c.key").alias("keys"), F.col("c.n").alias("counts"))
        runs = self.runs.join(found, F.col("run_id") == F.col("__r"), "left").drop("__r")
        return runs.mapInArrow(by(fixed), schema)

    def fit(self, base: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Counts that runs ask for, by expectation-maximization from those of certain events, and what it has added to them."""
        counts = base
        for _ in range(ROUNDS):
            before, added = counts, cut(self.judge(counts, _expect, "key string, n double").groupBy("key").agg(F.sum("n").alias("n")))
            counts = cut(_sum(base, added))
            if before is not base:
                drop(before)
        return counts, added

    def units(self, counts: DataFrame) -> DataFrame:
        """(doc_id, start_pos, end_pos)"""
        return self._decided(counts, ["doc_id"]).mapInArrow(_assemble, "doc_id bigint, start_pos bigint, end_pos bigint")

    def texts_with_units(self, counts: DataFrame) -> DataFrame:
        """(doc_id, text, starts, ends), if the texts were kept"""
        return self._decided(counts, ["doc_id", "text"]).mapInArrow(_assemble_texts, "doc_id bigint, text string, starts array<bigint>, ends array<bigint>")

    def _decided(self, counts: DataFrame, cols: list[str]) -> DataFrame:
        decided = cut(self.judge(counts, _decide, "run_id string, ends string"))
        open_runs = self.texts.where(F.size("runs") > 0).select("row_id", F.posexplode("runs").alias("at", "run"))
        open_runs = cut(open_runs.select("row_id", "at", F.md5("run").alias("run_id")))
        ends = lookup(open_runs, "run_id", decided, "run_id", "ends", "ends", open_runs.n_rows)
        ends = ends.groupBy("row_id").agg(F.collect_list(F.struct("at", "ends")).alias("c")).select(F.col("row_id").alias("__r"), F.col("c.at").alias("at"), F.col("c.ends").alias("ends"))
        whole = self.texts.where(F.size("runs") == 0).select(*cols, "pieces", F.expr("cast(null as array<int>)").alias("at"), F.expr("cast(null as array<string>)").alias("ends"))
        parted = self.texts.where(F.size("runs") > 0).join(ends, F.col("row_id") == F.col("__r")).select(*cols, "pieces", "at", "ends")
        return whole.unionByName(parted)


def _sum(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.unionByName(y).groupBy("key").agg(F.sum("n").alias("n"))


def train(documents: DataFrame) -> DataFrame:
    """The model's counts (key, n), from all texts."""
    corpus = _Corpus(documents)
    return cut(_sum(corpus.base, corpus.fit(corpus.wanted(corpus.base))[1]))


def units(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of text, in code points, without outer blanks."""
    out = []
    for start, end, g in gaps(text):
        ends = list(g.sure)
        for first, run in g.runs:
            ends += [gap[0] for gap, p in zip(run, model.posteriors(first, [gap[1:] for gap in run]), strict=True) if p >= 0.5]
        a = start
        for e in [*sorted(ends), end]:
            part = text[a:e]
            if bare := part.strip():
                a += part.index(bare[0])
                out.append((a, a + len(bare)))
            a = e
    return out


def sentences(documents: DataFrame, table: DataFrame | None = None, divide_unmarked: bool = False) -> DataFrame:
    """(doc_id, start_pos, end_pos): one row a sentence unit of every text; without a table of counts, one is trained on them first.

    Null, empty and blank texts have no units; repeated rows give repeated units; other columns are ignored. With
    divide_unmarked, units without an end mark are divided by the model over all gaps (see unmarked.py), else they go on to
    the end of their block.
    """
    corpus = _Corpus(documents, divide_unmarked)
    counts = corpus.wanted(corpus.base if table is None else table)
    counts = corpus.fit(counts)[0] if table is None else counts
    return divided(corpus.texts_with_units(counts), ENDS) if divide_unmarked else corpus.units(counts)
