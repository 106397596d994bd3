"""The prefix that two successive versions of a draft share, as far as a cache could use it."""

from __future__ import annotations

from os.path import commonprefix

_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'\u2019")


def longest_common_prefix(a: str, b: str) -> str:
    return commonprefix([a, b])


def snapped(text: str, end: int) -> int:
    """Inside a word: back to behind the last white space."""
    if not 0 < end < len(text):
        return max(0, min(end, len(text)))
    if not (text[end - 1] in _WORD and text[end] in _WORD):
        return end
    return max(text.rfind(c, 0, end) for c in " \t\n\r") + 1


def cacheable_prefix_end(previous: str | None, current: str | None) -> int:
    return snapped(current, len(commonprefix([previous, current]))) if previous and current else 0
