"""Extractive summaries: sentences scored by clusters of significant words, TF-IDF, place, query or a random walk, then picked for relevance and novelty."""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np

from ..functions.phrases import SENTENCE_ABBREVIATIONS, STOPWORDS
from ..options import SummaryOptions
from .jsontext import OPENER, Blobs
from .protect import code_spans
from .spans import SPACE, Taken

# Fixed values of the scoring.
WALK_LIMIT, WALK_STEPS, DAMPING, EDGE = 200, 25, 0.85, 0.05
RATIO, TRADE_OFF, GAP = 0.3, 0.7, 4

_TERM = re.compile(r"[A-Za-z0-9]+(?:['\u2019][A-Za-z]+)?")
_CLOSERS = "\"')]\u201d\u2019"
_BLANK = " \t\n\r"
_END = re.compile(rf"[.!?](?P<close>[{re.escape(_CLOSERS)}]*)(?P<gap>[{_BLANK}]*)|\n\n")
_LAST_WORD = re.compile(r"([A-Za-z0-9]*)\.*\Z")
_NO_END = frozenset(SENTENCE_ABBREVIATIONS)


class Sentence(NamedTuple):
    start: int
    end: int
    text: str
    tokens: list[str]


class Scored(NamedTuple):
    start: int
    end: int
    text: str
    score: float
    selected: bool


def tokenize(text: str) -> list[str]:
    """Lower-cased words of two letters or more, without stop words."""
    words = (m[0].replace("\u2019", "'").lower() for m in _TERM.finditer(text))
    return [w for w in words if len(w) > 1 and w not in STOPWORDS]


def ends_here(text: str, m: re.Match) -> bool:
    at = m.start()
    if text[at] == ".":
        before, behind = text[at - 1 : at], text[at + 1 : at + 2]
        if behind == "." or (before.isascii() and before.isdigit() and behind.isascii() and behind.isdigit()):
            return False
        word = _LAST_WORD.search(text, max(0, at - 64), at)[1].lower()
        if word in _NO_END or (len(word) == 1 and word.isalpha()):
            return False
    after = text[m.end() : m.end() + 1]
    return not after or (after == after.upper() and after != after.lower()) or after in "\"'(\u201c"


def split_sentences(text: str) -> list[Sentence]:
    """Sentences outside code and JSON values; a blank line ends one too."""
    blobs, taken = Blobs(text), Taken(code_spans(text))
    at = 0
    while m := OPENER.search(text, at):
        at = taken.free(m.start())
        if at == m.start():
            found = blobs.value_at(at)
            if found:
                taken = Taken([*taken.spans, (at, found[1])])
            at = found[1] if found else at + 1
    out: list[Sentence] = []

    def add(start: int, end: int) -> None:
        piece = text[start:end]
        start += len(piece) - len(piece.lstrip(_BLANK))
        if piece := piece.strip(_BLANK):
            out.append(Sentence(start, start + len(piece), piece, tokenize(piece)))

    edges = [*taken.spans, (len(text), len(text))]
    start = 0
    for stop, resume in edges:
        at = start
        while at < stop and (m := _END.search(text, at)) and m.start() < stop:
            if m[0] == "\n\n":
                add(start, m.start())
                start = at = m.end()
            elif ends_here(text, m):
                end = min(m.end("close"), len(text))
                add(start, end)
                start = at = end
            else:
                at = m.start() + 1
        add(start, stop)
        start = max(resume, start)
    return out


def spread(x: np.ndarray) -> np.ndarray:
    """Scaled to [0, 1]; all 0 where there is no spread."""
    span = x.max() - x.min()
    return (x - x.min()) / span if span > 1e-12 else np.zeros(len(x))


def cluster_score(tokens: list[str], significant: set[str]) -> float:
    """Best squared count over length of stretches whose significant words stand at most GAP apart."""
    places = [i for i, t in enumerate(tokens) if t in significant]
    best, first = 0.0, 0
    for k in range(1, len(places) + 1):
        if k == len(places) or places[k] - places[k - 1] - 1 > GAP:
            best = max(best, (k - first) ** 2 / (places[k - 1] - places[first] + 1))
            first = k
    return best


def walk(sims: np.ndarray) -> np.ndarray:
    """Ranks of a damped random walk; a place without edges spreads evenly."""
    n = len(sims)
    total = sims.sum(axis=1)
    step = np.where(total[:, None] > 0, sims / np.where(total > 0, total, 1)[:, None], 1 / n)
    rank = np.full(n, 1 / n)
    for _ in range(WALK_STEPS):
        rank = (1 - DAMPING) / n + DAMPING * (rank @ step)
    return rank


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def wanted(n: int, o: SummaryOptions) -> int:
    caps = [n]
    if o.max_sentences is not None:
        caps.append(max(0, math.floor(o.max_sentences)))
    if o.ratio is not None or (o.max_tokens is None and o.max_sentences is None):
        ratio = RATIO if o.ratio is None else o.ratio
        caps.append(max(1, half_up(n * min(1.0, max(0.0, ratio)))))
    return min(caps)


class Vectors:
    """The sentences' TF-IDF vectors, sparse: entries (row, column, value) by row, and where a column's entries are."""

    def __init__(self, sentences: list[Sentence]):
        n = len(sentences)
        self.df = Counter(t for s in sentences for t in dict.fromkeys(s.tokens))
        self.column = {t: k for k, t in enumerate(self.df)}
        self.idf = np.array([math.log((1 + n) / (1 + d)) + 1 for d in self.df.values()])
        made = [self.entries(s.tokens) for s in sentences]
        self.size = np.array([len(c) for c, _ in made])
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.row = np.repeat(np.arange(n), self.size)
        self.at, self.value = (np.concatenate([m[k] for m in made]) for k in (0, 1))
        self.norm = np.sqrt(np.bincount(self.row, weights=self.value**2, minlength=n))
        self.by_column = np.argsort(self.at, kind="stable")
        self.posting = np.concatenate([[0], np.cumsum(np.bincount(self.at, minlength=len(self.df)))])

    def entries(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = [(self.column[t], c) for t, c in Counter(tokens).items() if t in self.column]
        at = np.array([k for k, _ in known], np.int64)
        return at, np.array([c for _, c in known], float) / max(1, len(tokens)) * self.idf[at]

    def cosines(self, vector: np.ndarray) -> np.ndarray:
        """Of every sentence with a vector over the columns."""
        return self.scaled(np.bincount(self.row, weights=self.value * vector[self.at], minlength=len(self.size)), float(np.sqrt((vector**2).sum())))

    def scaled(self, dots: np.ndarray, norm: float) -> np.ndarray:
        both = self.norm * norm
        return np.divide(dots, both, out=np.zeros(len(dots)), where=both > 0)

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosine and Jaccard similarity of every sentence with sentence i, by the entries of its own terms alone."""
        own = slice(self.begin[i], self.begin[i + 1])
        spans = [self.by_column[self.posting[c] : self.posting[c + 1]] for c in self.at[own]]
        found = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        weight = np.repeat(self.value[own], [len(x) for x in spans])
        n = len(self.size)
        dots = np.bincount(self.row[found], weights=self.value[found] * weight, minlength=n)
        shared = np.bincount(self.row[found], minlength=n)
        union = self.size + self.size[i] - shared
        return self.scaled(dots, float(self.norm[i])), np.divide(shared, union, out=np.ones(n), where=union > 0)

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.size), len(self.df)))
        out[self.row, self.at] = self.value
        return out


def relevance(sentences: list[Sentence], o: SummaryOptions) -> tuple[np.ndarray, Vectors]:
    """(relevance, TF-IDF vectors)."""
    n = len(sentences)
    vectors = Vectors(sentences)
    df = vectors.df
    mean = np.bincount(vectors.at, weights=vectors.value, minlength=len(df)) / n
    central = spread(vectors.cosines(mean))
    significant = set(df) if n <= 2 else {t for t, d in df.items() if 2 <= d < n} or set(df)
    clusters = spread(np.array([cluster_score(s.tokens, significant) for s in sentences]))
    place = 1 - np.arange(n) / (n - 1) * 0.7
    place[-1] = max(place[-1], 0.6)
    place = spread(place)
    query = (o.query or "").strip(SPACE)
    asked = np.zeros(n)
    if query:
        wish = np.zeros(len(df))
        at, value = vectors.entries(tokenize(query))
        wish[at] = value
        asked = spread(vectors.cosines(wish))
    if o.method == "textrank" and n <= WALK_LIMIT:
        unit = vectors.dense() / np.where(vectors.norm > 0, vectors.norm, 1)[:, None]
        sims = unit @ unit.T
        np.fill_diagonal(sims, 0)
        rank = spread(walk(np.where(sims > EDGE, sims, 0)))
        return (0.7 * rank + 0.2 * asked + 0.1 * place if query else 0.85 * rank + 0.15 * place), vectors
    return (0.25 * clusters + 0.25 * central + 0.1 * place + 0.4 * asked if query else 0.4 * clusters + 0.4 * central + 0.2 * place), vectors


def pick(scores: np.ndarray, vectors: Vectors, sentences: list[Sentence], keep: int, o: SummaryOptions) -> list[bool]:
    """Greedy choice by relevance against likeness to what is picked, within the token budget; of equal ones the first."""
    n = len(sentences)
    weight = TRADE_OFF if o.trade_off is None or o.trade_off != o.trade_off else min(1.0, max(0.0, o.trade_off))
    cost = np.array([o.count(s.text) for s in sentences] if o.max_tokens is not None else [0] * n, float)
    likeness, free, used = np.zeros(n), np.ones(n, bool), 0.0
    for turn in range(keep):
        open_ = free if o.max_tokens is None or turn == 0 else free & (used + cost <= o.max_tokens)
        if not open_.any():
            break
        best = int(np.argmax(np.where(open_, weight * scores - (1 - weight) * likeness, -np.inf)))
        free[best] = False
        used += cost[best]
        likeness = np.maximum(likeness, np.maximum(*vectors.near(best)))
    return (~free).tolist()


def summarize(text: str | None, o: SummaryOptions = SummaryOptions()) -> tuple[str | None, list[Scored]]:
    """(summary, every sentence with its score and whether it is in the summary)."""
    if text is None:
        return None, []
    sentences = split_sentences(text) if text.strip(SPACE) else []
    if not sentences:
        return "", []
    if o.max_tokens is not None and o.max_tokens <= 0:
        return "", [Scored(s.start, s.end, s.text, 0.0, False) for s in sentences]
    if len(sentences) == 1:
        s = sentences[0]
        return s.text, [Scored(s.start, s.end, s.text, 1.0, True)]
    scores, vectors = relevance(sentences, o)
    chosen = pick(scores, vectors, sentences, wanted(len(sentences), o), o)
    out = [Scored(s.start, s.end, s.text, float(x), c) for s, x, c in zip(sentences, scores, chosen)]
    return " ".join(s.text for s in out if s.selected), out
