"""Options of the engine, resolved once on the driver and shipped with the tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

CHARS_PER_TOKEN = 4
HYGIENE_KINDS = ("secret", "pii", "injection")
KINDS = ("filler", "collapse", "contraction", "abbreviation", "hedge", "article", "unicode", "json", "table", "chrome", "dedupe", "aside", *HYGIENE_KINDS)


def estimate_tokens(text: str | None) -> int:
    """Four characters a token, rounded up."""
    return -(-len(text or "") // CHARS_PER_TOKEN)


@dataclass(frozen=True)
class Hygiene:
    secrets: bool = True
    pii: bool = True
    injection: bool = True

    def any(self) -> bool:
        return self.secrets or self.pii or self.injection


@dataclass(frozen=True)
class Options:
    """What find_bloat and compress look for; minify_json is "compact", "flatten" or None."""

    strict: bool = False
    remove_articles: bool = False
    minify_json: str | None = "compact"
    strip_markdown: bool = True
    dedupe_lines: bool = True
    strip_asides: bool | None = None  # None: as strict
    abbreviations: bool = True
    hygiene: Hygiene | None = Hygiene()
    tokenizer: Callable[[str], float] | None = None

    def asides(self) -> bool:
        return self.strict if self.strip_asides is None else self.strip_asides

    def count(self, text: str) -> float:
        return (self.tokenizer or estimate_tokens)(text)


@dataclass(frozen=True)
class SummaryOptions:
    """method: "fast" or "textrank" (fast beyond 200 sentences); trade_off: 1 is relevance alone, 0 novelty alone."""

    max_tokens: float | None = None
    max_sentences: float | None = None
    ratio: float | None = None
    query: str | None = None
    method: str = "fast"
    trade_off: float | None = None
    tokenizer: Callable[[str], float] | None = None

    def count(self, text: str) -> float:
        return (self.tokenizer or estimate_tokens)(text)
