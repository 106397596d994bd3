"""JSON inside prose: finding blobs, and writing values the way a JavaScript engine does."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

OPENER = re.compile(r"(?<![A-Za-z0-9_$])[\[{]")
_LEXEME = re.compile(r'"(?:[^"\\]|\\.)*"|["\[\]{}]', re.S)
_ESCAPE = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = re.compile(r'["\\\x00-\x1f\ud800-\udfff]')
_INDEX = re.compile(r"(?:0|[1-9][0-9]{0,9})\Z")


def number(x: float) -> str:
    """Shortest digits; exponents only below 1e-6 and from 1e21 on."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, power = f"{abs(x)!r}".partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits, point = whole + fraction, len(whole) + int(power or 0)
    lead = len(digits) - len(digits.lstrip("0"))
    digits, point = digits[lead:], point - lead
    digits = digits.rstrip("0")
    if 0 < point <= 21:
        return sign + (digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}")
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    tail = f".{digits[1:]}" if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{tail}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def quoted(text: str) -> str:
    return '"' + _SPECIAL.sub(lambda m: _ESCAPE.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    """Last value and first place of a key; keys that are array indexes come first, ascending."""
    out = dict(pairs)
    indexes = [k for k in out if _INDEX.match(k) and int(k) < 2**32 - 1]
    if not indexes:
        return out
    return {k: out[k] for k in [*sorted(indexes, key=int), *(k for k in out if k not in set(indexes))]}


def _refuse(name: str) -> Any:
    raise ValueError(name)


def parse(raw: str) -> Any:
    return json.loads(raw, object_pairs_hook=_object, parse_int=float, parse_constant=_refuse)


def plain(value: Any) -> bool:
    return value is None or isinstance(value, (str, float, bool))


def shown(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else number(value)


def compact(value: Any) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{quoted(k)}:{compact(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    if isinstance(value, str):
        return quoted(value)
    return "null" if isinstance(value, float) and value in (float("inf"), float("-inf")) else shown(value)


def cells(value: Any, path: str = "") -> list[str]:
    """Dotted paths with their values."""
    label = f"{path}:" if path else ""
    if isinstance(value, dict) and value:
        return [c for k, v in value.items() for c in cells(v, f"{path}.{k}" if path else k)]
    if isinstance(value, dict):
        return [label + "{}"]
    if isinstance(value, list):
        if not value:
            return [label + "[]"]
        if all(map(plain, value)):
            return [label + ",".join(map(shown, value))]
        return [label + ";".join("|".join(cells(x)) for x in value)]
    return [label + shown(value)]


def flat(value: Any) -> str:
    return "|".join(cells(value))


def uniform(value: Any) -> bool:
    """A list of objects with one and the same set of keys, and no value that holds others."""
    if not (isinstance(value, list) and value and isinstance(value[0], dict) and value[0]):
        return False
    keys = value[0].keys()
    return all(isinstance(row, dict) and row.keys() == keys and all(map(plain, row.values())) for row in value)


def csv_cell(raw: str) -> str:
    return '"' + raw.replace('"', '""') + '"' if re.search(r'[",\n\r]', raw) else raw


def table(value: Any) -> str | None:
    """A uniform list as CSV, with the keys of its first row as header; else None."""
    if not uniform(value):
        return None
    keys = list(value[0])
    rows = [keys, *([shown(row[k]) for k in keys] for row in value)]
    return "\n".join(",".join(csv_cell(c) for c in row) for row in rows)


def shorter(value: Any) -> str:
    """CSV where that is shorter, else compact JSON."""
    short, csv = compact(value), table(value)
    return csv if csv is not None and len(csv) < len(short) else short


class Blobs:
    """Where the brackets of one text close. One scan from an outer bracket answers for those inside it."""

    def __init__(self, text: str):
        self.text = text
        self._ends: dict[int, int | None] = {}
        self._values: dict[int, Any] = {}

    def end(self, start: int) -> int | None:
        """The place behind the bracket that balances the one at `start`, whatever its kind; None: there is none."""
        if start not in self._ends:
            stack: list[int] = []
            for m in _LEXEME.finditer(self.text, start):
                if m[0] in "[{":
                    stack.append(m.start())
                elif m[0] in "]}":
                    self._ends[stack.pop()] = m.end()
                    if not stack:
                        break
                elif m[0] == '"':
                    break  # a string that never ends
            for opener in stack:
                self._ends.setdefault(opener, None)
        return self._ends[start]

    def unclosed(self, start: int) -> bool:
        return self.end(start) is None

    def value_at(self, start: int) -> tuple[Any, int] | None:
        """The value of valid JSON at a bracket, and its end."""
        if start not in self._values:
            end = self.end(start)
            try:
                self._values[start] = None if end is None else (parse(self.text[start:end]), end)
            except (ValueError, RecursionError):
                self._values[start] = None
        return self._values[start]

    def rewritten(self, write) -> str:
        """The text with every blob written anew."""
        out, at = [], 0
        for start, end, value in self.walk():
            out += [self.text[at:start], write(value)]
            at = end
        return "".join(out) + self.text[at:]

    def walk(self) -> Iterator[tuple[int, int, Any]]:
        at = 0
        while m := OPENER.search(self.text, at):
            found = self.value_at(m.start())
            if found:
                yield m.start(), found[1], found[0]
            at = found[1] if found else m.end()


def minify_json(text: str | None, mode: str = "compact") -> str | None:
    """Every JSON value in the text, compact or flattened."""
    return Blobs(text).rewritten(flat if mode == "flatten" else compact) if text else text


def minify_json_table(text: str | None) -> str | None:
    """Every JSON value in the text, as CSV where that is shorter, else compact."""
    return Blobs(text).rewritten(shorter) if text else text


def json_table(raw: str | None) -> str | None:
    """One JSON value: CSV whenever its shape allows, even if longer, else compact; null if invalid."""
    try:
        value = parse(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    if raw is None:
        return None
    csv = table(value)
    return compact(value) if csv is None else csv


def flatten_json(raw: str | None) -> list[str] | None:
    """The cells of one JSON value; null if invalid."""
    try:
        return None if raw is None else cells(parse(raw))
    except (ValueError, RecursionError):
        return None
