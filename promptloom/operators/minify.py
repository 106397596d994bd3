"""Minifiers for payloads of one format: YAML, XML and HTML, Markdown, code, CSV and TSV."""

from __future__ import annotations

import re

from .markup import chrome_hits, table_hits
from .protect import protected_spans
from .spans import SPACE, Taken

_S = re.escape(SPACE)
_BLANKS = re.compile("\n{3,}")

_YAML = re.compile(r"""(?s)("(?:\\.|[^"\\]|\\\Z)*(?:"|\Z)|'[^']*(?:'|\Z))|#[^\n]*""")
_SCALAR = re.compile(rf"([{_S}]*)([A-Za-z_][A-Za-z0-9_-]*)[{_S}]*:[{_S}]+([^{_S}|>{{\[][^\n\r\u2028\u2029]*)\Z")


def minify_yaml(text: str | None) -> str | None:
    """Without comments outside quotes (which may span lines), and `key:value` for plain scalars."""
    if not text:
        return text
    lines = (x.rstrip(" \t") for x in _YAML.sub(lambda m: m[1] or "", text).split("\n"))
    short = (f"{m[1]}{m[2]}:{m[3]}" if (m := _SCALAR.match(x)) else x for x in lines)
    return _BLANKS.sub("\n\n", "\n".join(short)).strip(SPACE)


_XML = re.compile(r"(?s)<!--.*?-->|(<!--.*)|<[^>]*>|(<.*)")


def minify_xml(text: str | None) -> str | None:
    """Text between tags and comments, on one line; what is never closed stays."""
    if not text:
        return text
    return re.sub(f"[{_S}]+", " ", _XML.sub(lambda m: m[1] or m[2] or "", text)).strip(SPACE)


def minify_markdown(text: str | None) -> str | None:
    """Tables as TSV, then chrome stripped, outside protected spans."""
    if not text:
        return text
    taken = Taken(protected_spans(text))
    hits = table_hits(text, taken)
    for start, end, _ in hits:
        taken.add(start, end)
    out, at = [], 0
    for start, end, replacement in sorted(hits + chrome_hits(text, taken)):
        out += [text[at:start], replacement]
        at = end
    return _BLANKS.sub("\n\n", "".join(out) + text[at:]).strip(SPACE)


_CODE = re.compile(r"""(?s)"(?:\\.|[^"\\])*+(?:"|\\?\Z)|'(?:\\.|[^'\\])*+(?:'|\\?\Z)|`(?:\\.|[^`\\])*+(?:`|\\?\Z)|(?P<line>//)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<hash>\#)""")
_NO_COMMENT = re.compile(
    rf"""(?a)\#[{_S}]*(?:include|define|undef|ifdef|ifndef|endif|pragma|else|elif|if|error|warning|line)\b
    |\#(?:[0-9a-fA-F]{{3}}|[0-9a-fA-F]{{4}}|[0-9a-fA-F]{{6}}|[0-9a-fA-F]{{8}})\b
    |\#[A-Za-z][A-Za-z0-9_-]*[{_S}]*[{{,.[\#]""".replace("\n    ", "")
)


def minify_code(text: str | None) -> str | None:
    """Without //, /* */ and # comments; strings, preprocessor lines, hex colours and CSS ids stay."""
    if not text:
        return text
    out, at, seek = [], 0, 0
    while m := _CODE.search(text, seek):
        seek, cut = m.end(), m["block"] is not None
        end = m.end()
        if m["line"] or (m["hash"] and not _NO_COMMENT.match(text, m.start()) and (m.start() == 0 or text[m.start() - 1] in " \t\n")):
            line = text.find("\n", m.end())
            end, cut = (len(text) if line < 0 else line), True
        if cut:
            out.append(text[at : m.start()])
            at = seek = end
    return _BLANKS.sub("\n\n", "".join(out) + text[at:])


_QUOTED = r'"((?:[^"]|"")*+)(?:"|\Z)'


def parse_delimited(text: str, delimiter: str) -> list[list[str]]:
    """Cells, row by row; quotes may open anywhere in a cell."""
    rows: list[list[str]] = [[""]]
    for m in re.finditer(rf"{_QUOTED}|({delimiter})|(\n)|[^\"\n{delimiter}]+", text):
        if m[2]:
            rows[-1].append("")
        elif m[3]:
            rows.append([""])
        else:
            rows[-1][-1] += m[1].replace('""', '"') if m[0][0] == '"' else m[0]
    return rows


def minify_csv(text: str | None) -> str | None:
    """Trimmed cells, without rows and columns that are empty throughout."""
    if not text:
        return text
    first = re.sub(_QUOTED, "", re.split("\r?\n", text, maxsplit=1)[0])
    delimiter = "\t" if first.count("\t") > first.count(",") else ","
    rows = [cells for row in parse_delimited(text, delimiter) if any(cells := [c.strip(SPACE) for c in row])]
    used = sorted({k for row in rows for k, c in enumerate(row) if c})
    quote = lambda c: '"' + c.replace('"', '""') + '"' if delimiter == "," and re.search(r'[",\n\r]', c) else c
    return "\n".join(delimiter.join(quote(row[k]) for k in used if k < len(row)) for row in rows)
