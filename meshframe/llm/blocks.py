"""Where sentence units can't cross: paragraphs, list items, headings and quoted lines of a text, without its code blocks."""

from __future__ import annotations

import re

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_FENCE = re.compile(r"\s*(`{3,}(?=[^`]*$)|~{3,})")
_OPENS = re.compile(r"\s{0,3}(?:#{1,6}(?=\s|$)|>)|\s*(?:[-*+•‣⁃◦▪●]|\d{1,4}[.)])(?=\s)")
#: Markers at the start of a block, before its first word.
_MARKS = re.compile(r"\s*(?:>\s*)*(?:#{1,6}\s+)?(?:[-*+•‣⁃◦▪●]\s+|\d{1,4}[.)]\s+(?!\d{1,3}\.\s))?")
_PRE = re.compile(r"<pre\b[^>]*>", re.I)
_PRE_END = re.compile(r"</pre\s*>", re.I)


def _without_pre(text: str) -> list[tuple[int, int]]:
    """Parts of text outside of HTML code blocks; one that isn't closed runs to the end."""
    out, at = [], 0
    for m in _PRE.finditer(text):
        if m.start() < at:
            continue
        out.append((at, m.start()))
        end = _PRE_END.search(text, m.end())
        at = end.end() if end else len(text)
    out.append((at, len(text)))
    return out


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, first word) of each block; outer white space may be included."""
    if "\n" not in text and "\r" not in text and "<" not in text and not text.startswith(("    ", "\t", "```", "~~~")):
        return [(0, len(text), _MARKS.match(text).end())] if text.strip() else []
    out: list[tuple[int, int, int]] = []
    fence = ""
    for begin, end in _without_pre(text) if "<" in text else [(0, len(text))]:
        start = -1
        for m in _LINE.finditer(text, begin, end):
            a, b = m.span()
            if a == b:
                continue
            line = text[a:b]
            if fence:
                if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                    fence = ""
                continue
            bare = line.strip()
            opened = _FENCE.match(line.rstrip()) if bare[:1] in ("`", "~") else None
            whole_line = a == 0 or text[a - 1] in "\r\n"
            code = start < 0 and whole_line and line.startswith(("    ", "\t"))
            if start >= 0 and (not bare or opened or (whole_line and _OPENS.match(line))):
                out.append((start, a, _MARKS.match(text, start, a).end()))
                start = -1
            if opened:
                fence = opened.group(1)
            elif bare and start < 0 and not code:
                start = a
        if start >= 0:
            out.append((start, end, _MARKS.match(text, start, end).end()))
    return out
