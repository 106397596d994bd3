"""The cascade over one text: what can be compressed, what is hazardous, and the text rewritten."""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..options import Options
from .dictionary import Dictionary, Rule
from .finding import Finding, apply_findings
from .hygiene import find_hygiene
from .jsontext import OPENER, Blobs, compact, flat, table
from .markup import Hit, aside_hits, chrome_hits, repeat_hits, table_hits, unicode_hits
from .protect import protected_spans
from .spans import SPACE, Taken


def squeeze(text: str) -> str:
    """Single spaces, none round line ends, one blank line at most, none at the edges. Tabs stay."""
    text = re.sub(" +", " ", text)
    text = re.sub(" *\n *", "\n", text)
    return re.sub("\n{3,}", "\n\n", text).strip(SPACE)


def json_hits(text: str, taken: Taken, blobs: Blobs, mode: str) -> list[tuple[int, int, str, str]]:
    """Values that get shorter; each valid value is taken, shorter or not."""
    out, at = [], 0
    while m := OPENER.search(text, at):
        at = taken.free(m.start())
        if at > m.start():
            continue
        found = blobs.value_at(at)
        if not found or taken.meets(at, found[1]):
            at += 1
            continue
        value, end = found
        short, kind = (flat(value), "json") if mode == "flatten" else (compact(value), "json")
        csv = None if mode == "flatten" else table(value)
        if csv is not None and len(csv) < len(short):
            short, kind = csv, "table"
        taken.add(at, end)
        if len(short) < end - at:
            out.append((at, end, short, kind))
        at = end
    return out


class Engine:
    """Options and compiled rules; one for each task."""

    def __init__(self, options: Options = Options(), rules: Iterable[Rule] | None = None):
        self.options = options
        self.dictionary = Dictionary(options, rules)

    def find(self, text: str | None) -> list[Finding]:
        """Findings by start. Each pass claims its spans from the later ones, kept or not."""
        if not text:
            return []
        o, blobs = self.options, Blobs(text)
        taken = Taken(protected_spans(text, blobs))
        hits: list[tuple[int, int, str, str]] = []

        def claim(found: list[Hit], kind: str) -> None:
            for start, end, replacement in found:
                hits.append((start, end, replacement, kind))
                taken.add(start, end)

        claim(unicode_hits(text, taken, blobs), "unicode")
        if o.minify_json:
            hits += json_hits(text, taken, blobs, o.minify_json)
        if o.strip_markdown:
            claim(table_hits(text, taken), "table")
            claim(chrome_hits(text, taken), "chrome")
        if o.dedupe_lines:
            claim(repeat_hits(text, taken), "dedupe")
        if o.asides():
            claim(aside_hits(text, taken), "aside")
        hits += self.dictionary.hits(text, taken)
        hazards = find_hygiene(text, o.hygiene)
        danger = Taken((h.start, h.end) for h in hazards)
        out = [f for h in hits if (f := self.gated(text, *h)) and not danger.meets(f.start, f.end)]
        return sorted([*out, *hazards], key=lambda f: f.start)

    def gated(self, text: str, start: int, end: int, replacement: str, kind: str) -> Finding | None:
        """The finding, if it saves tokens; by the default estimate also if it saves characters."""
        original = text[start:end]
        before, after = self.options.count(original), self.options.count(replacement)
        if not before > after:
            if self.options.tokenizer or not (len(replacement) < len(original) or (kind == "unicode" and before >= after)):
                return None
        return Finding(start, end, original, replacement, kind, tokens_saved=max(0, before - after), id=f"{kind}:{start}:{end}")

    def compress(self, text: str | None) -> str | None:
        return squeeze(apply_findings(text, self.find(text))) if text is not None else None

    def analyze(self, text: str | None) -> tuple[list[Finding], str | None, int, int]:
        """(findings, compressed, tokens now, tokens after) from one run of the cascade."""
        if text is None:
            return [], None, 0, 0
        found = self.find(text)
        short = squeeze(apply_findings(text, found))
        return found, short, self.options.count(text), self.options.count(short)
