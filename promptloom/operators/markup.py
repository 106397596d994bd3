"""Passes over markup: Unicode look-alikes, pipe tables, markdown and HTML chrome, repeated lines, asides."""

from __future__ import annotations

import re

from ..functions.phrases import ASIDES
from .jsontext import Blobs
from .spans import SPACE, Taken

Hit = tuple[int, int, str]

#: What look-alikes become.
LOOKALIKES = {
    **dict.fromkeys("\ufeff\u200b\u200c\u200d\u2060", ""),
    **dict.fromkeys("\u00a0\u202f\u2007", " "),
    **dict.fromkeys("\u2018\u2019\u201a\u201b", "'"),
    **dict.fromkeys("\u201c\u201d\u201e\u201f", '"'),
    "\u2026": "...",
}
_LOOKALIKE = re.compile(f"[{''.join(LOOKALIKES)}]")
_STOP = re.compile(rf"[{''.join(LOOKALIKES)}]|(?<![A-Za-z0-9_$])[\[{{]|(?m:^)\|")
_FOLD = str.maketrans(LOOKALIKES)


def normalize_unicode(text: str | None) -> str | None:
    return text.translate(_FOLD) if text else text


def unicode_hits(text: str, taken: Taken, blobs: Blobs) -> list[Hit]:
    """Runs of look-alikes outside taken spans, JSON values and tables."""
    out, at = [], 0
    while m := _STOP.search(text, at):
        at = taken.free(m.start())
        if at > m.start():
            continue
        if m[0] in "[{":
            found = blobs.value_at(at)
            at = found[1] if found else at + 1
        elif m[0] == "|":
            found = table_at(text, at)
            at = found[1] if found else at + 1
        else:
            end = at + 1
            while end < len(text) and _LOOKALIKE.match(text, end) and not taken.holder(end):
                end += 1
            out.append((at, end, text[at:end].translate(_FOLD)))
            at = end
    return out


def row_cells(line: str) -> list[str] | None:
    """Cells of a pipe row, or None."""
    line = line.strip(SPACE)
    if not line.startswith("|"):
        return None
    inner = line[1:-1] if line.endswith("|") and len(line) > 1 else line[1:]
    return [c.strip(SPACE) for c in inner.split("|")]


def table_at(text: str, start: int) -> Hit | None:
    """The table whose header line starts here, as tab-separated lines; None if a row doesn't fit or nothing is won."""
    rows, at, end = [], start, start
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        cells = row_cells(text[at:stop])
        if cells is None or (len(rows) > 1 and at >= len(text)):
            break
        if rows and len(cells) != len(rows[0]) or len(rows) == 1 and not all(re.fullmatch(":?-{3,}:?", c) for c in cells):
            return None
        rows.append(cells)
        end, at = stop, stop + 1
    if len(rows) < 2:
        return None
    made = "\n".join("\t".join(r) for r in [rows[0], *rows[2:]])
    return (start, end, made) if len(made) < end - start else None


def table_hits(text: str, taken: Taken) -> list[Hit]:
    taken, out, at = Taken(taken.spans), [], 0
    while at < len(text):
        free = taken.free(at)
        if free > at:
            at = free
            continue
        if at == 0 or text[at - 1] == "\n":
            hit = table_at(text, at)
            if hit and not taken.meets(hit[0], hit[1]):
                out.append(hit)
                taken.add(hit[0], hit[1])
                at = hit[1]
                continue
        line = text.find("\n", at)
        at = len(text) if line < 0 else line + 1
    return out


_CHROME_START = re.compile(r"(?m)^[ \t]*(?=-{3}|\*{3}|_{3})|[<*_]")
_RULE = re.compile(r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*(?:\n|\Z)")
_COMMENT = re.compile(r"(?s)<!--.*?-->")
_TAG = re.compile(r"(?ai)<(strong|em|p|b|i)(?:>|[ \t/][^>]*(?<!/)>)([^<]*)</\1>")
_STRONG = {m: re.compile(rf"{re.escape(m * 2)}(?!{re.escape(m)})([^\n]+?){re.escape(m * 2)}") for m in "*_"}
_WEAK = {m: re.compile(rf"(?<![A-Za-z0-9]){re.escape(m)}(?![{re.escape(m)} ])([^{re.escape(m)}\n]*[^{re.escape(m)}\n ]){re.escape(m)}(?![{re.escape(m)}A-Za-z0-9])") for m in "*_"}


def chrome_at(text: str, at: int) -> list[Hit]:
    """All that could be stripped at one place, in order of preference among equals."""
    out = [(at, m.end(), "") for p in (_RULE, _COMMENT) if (m := p.match(text, at))]
    if m := _TAG.match(text, at):
        out.append((at, m.end(), m[2]))
    for kind in (_STRONG, _WEAK):
        m = (p := kind.get(text[at])) and p.match(text, at)
        if m and m[1].strip(SPACE):
            line_start = at == 0 or text[at - 1] == "\n"
            if not (kind is _WEAK and line_start and m[1][0] in " \t"):
                out.append((at, m.end(), m[1]))
    return out


def chrome_hits(text: str, taken: Taken) -> list[Hit]:
    """Rules, comments, wrapping tags and emphasis; the longest at a place wins."""
    taken, out, at = Taken(taken.spans), [], 0
    while at < len(text) and (m := _CHROME_START.search(text, at)):
        at = taken.free(m.start())
        if at > m.start():
            continue
        found = [h for h in chrome_at(text, at) if not taken.meets(h[0], h[1])] if at < len(text) else []
        if found:
            best = max(found, key=lambda h: h[1] - h[0])
            out.append(best)
            taken.add(best[0], best[1])
            at = best[1]
        else:
            at += 1
    return out


_PARAGRAPH_END = re.compile(r"\n[ \t]*\n")


def repeat_hits(text: str, taken: Taken) -> list[Hit]:
    """Consecutive equal lines, then consecutive equal paragraphs, without the first of each."""
    taken, out = Taken(taken.spans), []

    def claim(start: int, end: int) -> None:
        if end > start and not taken.meets(start, end):
            out.append((start, end, ""))
            taken.add(start, end)

    kept, at, before = None, 0, 0
    for n, raw in enumerate(text.split("\n")):
        content = raw.removesuffix("\r")
        end, eol = at + len(content), min(at + len(raw) + 1, len(text))
        line = content.strip(SPACE)
        holder = taken.holder(at)
        if (holder and holder[1] >= end) or taken.meets(at, eol):
            kept = None
        elif line and line == kept and n:
            claim(before, end)
        else:
            kept = line or None
        at, before = at + len(raw) + 1, end
    cuts = [(0, 0), *(m.span() for m in _PARAGRAPH_END.finditer(text)), (len(text), len(text))]
    kept, before = None, 0
    for (_, start), (end, _) in zip(cuts, cuts[1:]):
        block = text[start:end].strip(SPACE) if end > start else ""
        if not block:
            continue
        if taken.meets(start, end):
            kept = None
        elif block == kept and start > before:
            claim(before, end)
        else:
            kept, before = block, end
    return out


_ASIDE = re.compile(r"\(([^()\n]{0,79})\)|[\u2013\u2014]([^\u2013\u2014\n]{1,79})[\u2013\u2014]")


def strippable(interior: str) -> bool:
    folded = re.sub(f"[{re.escape(SPACE)}]+", " ", interior.replace("\u2019", "'").lower()).strip(" ")
    return folded in ASIDES


def aside_hits(text: str, taken: Taken) -> list[Hit]:
    taken, out, at = Taken(taken.spans), [], 0
    while m := _ASIDE.search(text, at):
        at = taken.free(m.start())
        if at > m.start():
            continue
        if strippable(m[1] if m[1] is not None else m[2]) and not taken.meets(*m.span()):
            out.append((*m.span(), ""))
            taken.add(*m.span())
            at = m.end()
        else:
            at += 1
    return out
