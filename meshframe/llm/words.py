"""Words compared without regard to case, accents, compatibility forms and invisible format characters."""

from __future__ import annotations

import re
import unicodedata

import regex

_MARKS = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """text in the form in which words are compared."""
    if text.isascii():
        return text.lower()
    x = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _MARKS.sub("", x)


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits of the folded text; the underscore is neither."""
    return _WORD.findall(fold(text))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each of words(text) in code points of text itself."""
    if text.isascii():
        return [m.span() for m in _WORD.finditer(text)]
    out, start, end = [], -1, -1
    for i, c in enumerate(text):
        for x in fold(c):
            if _WORD.match(x):
                if start < 0:
                    start = i
                end = i + 1
            elif start >= 0:
                out.append((start, end))
                start = -1
    if start >= 0:
        out.append((start, end))
    return out
