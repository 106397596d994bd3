"""Spans that no rewrite may touch: code, links, addresses, dates, versions, and JSON that is still being typed."""

from __future__ import annotations

import re

from .jsontext import OPENER, Blobs
from .spans import SPACE, Taken, merged

_S = re.escape(SPACE)
#: An opening fence, a run of backticks, or the start of a comment.
_CODE = re.compile(r"(?m)(?:(?<=\n)|\A)[ \t]{0,3}(?P<fence>`{3,}|~{3,})|(?P<ticks>`+)|(?P<comment><!--)")
_TICKS = re.compile("`+")
LINK = re.compile(rf"(?ai:https?://)[^{_S}<>\"'`]+")
WWW = re.compile(rf"(?ai:www\.)[^{_S}<>\"'`]+")
_TAIL = ".,;:!?)]>'\""
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?")
VERSION = re.compile(r"(?a)\b[0-9]+\.[0-9]+\.[0-9]+(?:-[A-Za-z0-9.-]+)?\b")


def code_spans(text: str) -> list[tuple[int, int]]:
    """Fenced and inline code, and a comment that is never closed; what stays open runs to the end."""
    out, at = [], 0
    while m := _CODE.search(text, at):
        if fence := m["fence"]:
            start = m.start("fence")
            line = text.find("\n", start)
            close = re.compile(rf"(?m)^[ \t]{{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*(?:\n|\Z)").search(text, line + 1) if line >= 0 else None
            end = close.end() if close else len(text)
        elif ticks := m["ticks"]:
            start = m.start()
            end = next((x.end() for x in _TICKS.finditer(text, m.end()) if len(x[0]) == len(ticks)), len(text))
        else:
            start = m.start()
            if text.find("-->", m.end()) >= 0:
                at = m.end()
                continue
            end = len(text)
        out.append((start, end))
        at = end
        if end == len(text):
            break
    return merged(out)


def links(text: str) -> list[tuple[int, int]]:
    """Links without the punctuation behind them."""
    found = [(m.start(), m.start() + len(m[0].rstrip(_TAIL))) for p in (LINK, WWW) for m in p.finditer(text)]
    return merged(found)


def protected_spans(text: str, blobs: Blobs | None = None) -> list[tuple[int, int]]:
    spans = code_spans(text) + links(text)
    spans += [m.span() for p in (EMAIL, DATE, VERSION) for m in p.finditer(text)]
    taken, blobs = Taken(spans), blobs or Blobs(text)
    at = 0
    while m := OPENER.search(text, at):
        at = taken.free(m.start())
        if at > m.start():
            continue
        if blobs.unclosed(at):
            return merged([*taken.spans, (at, len(text))])
        at += 1
    return taken.spans
