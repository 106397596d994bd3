"""Findings: spans of a text with what could replace them."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from ..options import HYGIENE_KINDS


class Finding(NamedTuple):
    """Places count code points; `end` is exclusive."""

    start: int
    end: int
    original_text: str
    replacement: str
    kind: str
    severity: str = "info"
    message: str | None = None
    tokens_saved: int = 0
    id: str | None = None


def finding_id(f: Finding) -> str:
    return f.id if f.id is not None else f"{f.kind}:{f.start}:{f.end}"


def apply_finding(text: str, f: Finding) -> str:
    """The text with one finding applied, or as it is if that doesn't fit it."""
    fits = 0 <= f.start <= f.end <= len(text) and (f.original_text is None or text[f.start : f.end] == f.original_text)
    return text[: f.start] + f.replacement + text[f.end :] if fits else text


def apply_findings(text: str, findings: Iterable[Finding], include: Iterable[str] | None = None) -> str:
    """All findings that fit the text, from its end to its start; without `include`, all but hazards."""
    wanted = None if include is None else set(include)
    out = text
    for f in sorted(findings, key=lambda f: (-f.start, -f.end)):
        if (f.kind in wanted) if wanted is not None else (f.kind not in HYGIENE_KINDS):
            if apply_finding(text, f) is not text:
                out = out[: f.start] + f.replacement + out[f.end :]
    return out


def diff_findings(before: Iterable[Finding], after: Iterable[Finding]) -> tuple[list[Finding], list[str], list[str]]:
    """(added, removed ids, unchanged ids)."""
    old, new = list(dict.fromkeys(map(finding_id, before))), list(after)
    there, known = {finding_id(f) for f in new}, set(old)
    return [f for f in new if finding_id(f) not in known], [i for i in old if i not in there], [i for f in new if (i := finding_id(f)) in known]
