"""Sets of disjoint spans of one text, kept sorted."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable

#: What counts as white space where the engine trims or folds.
SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Non-empty spans, sorted, with overlapping and abutting ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(s for s in spans if s[1] > s[0]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


class Taken:
    """Spans that a pass may not touch. Lookups are by bisection; spans never overlap each other."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.spans = merged(spans)

    def holder(self, at: int) -> tuple[int, int] | None:
        """The span over a place."""
        k = bisect_right(self.spans, (at, 1 << 62)) - 1
        return self.spans[k] if k >= 0 and at < self.spans[k][1] else None

    def meets(self, start: int, end: int) -> bool:
        """Whether a span overlaps [start, end); touching is no overlap."""
        k = bisect_right(self.spans, (end - 1, 1 << 62)) - 1
        while k >= 0 and self.spans[k][1] > start:
            if self.spans[k][0] < end and self.spans[k][1] > start:
                return True
            k -= 1
        return False

    def free(self, at: int) -> int:
        """The first place from `at` on that no span covers."""
        while (span := self.holder(at)) is not None:
            at = span[1]
        return at

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))
