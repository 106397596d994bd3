"""Phrase rewriting: the longest phrase at the leftmost place, between word boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from ..functions.phrases import ABBREVIATIONS, ARTICLES, COLLAPSES, CONTRACTIONS, HEDGES, POLITE_FILLER, STRICT_FILLER
from ..options import Options
from .spans import Taken

#: Stand for a taken character that is, or isn't, part of a word.
WORD, OTHER = "\ue000", "\ue001"
_WORD_CHARS = "A-Za-z0-9'\u2019"


class Rule(NamedTuple):
    phrase: str
    replacement: str
    kind: str
    gate: str = ""  # "", "strict", "articles" or "abbreviations"


def default_rules() -> list[Rule]:
    rules = [Rule(p, "", "filler") for p in POLITE_FILLER]
    rules += [Rule(p, "", "filler", "strict") for p in STRICT_FILLER]
    rules += [Rule(p, "", "hedge", "strict") for p in HEDGES]
    rules += [Rule(p, r, "collapse") for p, r in COLLAPSES]
    rules += [Rule(p, r, "abbreviation", "abbreviations") for p, r in ABBREVIATIONS]
    rules += [Rule(p, r, "contraction") for p, r in CONTRACTIONS]
    return rules + [Rule(p, "", "article", "articles") for p in ARTICLES]


def active(options: Options, rules: Iterable[Rule] | None = None) -> dict[str, Rule]:
    """The rules that the options let through; of one phrase the first."""
    on = {"": True, "strict": options.strict, "articles": options.remove_articles, "abbreviations": options.abbreviations}
    out: dict[str, Rule] = {}
    for rule in default_rules() if rules is None else rules:
        if on[rule.gate]:
            out.setdefault(rule.phrase, rule)
    return out


def pattern_of(phrases: Iterable[str]) -> str:
    """One regular expression for all phrases, as a trie, so that longer ones are tried first at little cost."""
    trie: dict = {}
    for phrase in phrases:
        node = trie
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = []
        for c, below in node.items():
            if c:
                branches.append(("['\u2019]" if c == "'" else re.escape(c)) + render(below))
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return f"{body}?" if "" in node else body

    return rf"(?ai)(?<![{_WORD_CHARS}{WORD}]){render(trie)}(?![{_WORD_CHARS}{WORD}])"


class Dictionary:
    """Compiled rules; made once a task."""

    def __init__(self, options: Options, rules: Iterable[Rule] | None = None):
        self.rules = active(options, rules)
        self.pattern = re.compile(pattern_of(self.rules)) if self.rules else None

    def hits(self, text: str, taken: Taken) -> list[tuple[int, int, str, str]]:
        """(start, end, replacement, kind) outside taken spans."""
        if self.pattern is None:
            return []
        hidden = masked(text, taken)
        out = []
        for m in self.pattern.finditer(hidden):
            if m.end() > m.start():
                rule = self.rules[m[0].lower().replace("\u2019", "'")]
                out.append((*m.span(), cased(text[m.start() : m.end()], rule.replacement), rule.kind))
        return out


def masked(text: str, taken: Taken) -> str:
    """The text, as long as before, with taken characters hidden but for their being word characters."""
    out, at = [], 0
    for start, end in taken.spans:
        out += [text[at:start], re.sub(rf"[^{WORD}]", OTHER, re.sub(rf"[{_WORD_CHARS}]", WORD, text[start:end]))]
        at = end
    return "".join(out) + text[at:] if out else text


def cased(original: str, replacement: str) -> str:
    """The replacement in the casing of the original; acronyms stay."""
    if not replacement or (replacement == replacement.upper() and re.search("[A-Z]", replacement)):
        return replacement
    if re.search("[A-Z]", original) and not re.search("[a-z]", original):
        return replacement.upper()
    return replacement[0].upper() + replacement[1:] if original[0] != original[0].lower() else replacement
