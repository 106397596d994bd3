"""Likeness to the centroid, against a plain version, and how much of it is shuffled."""

import math
from collections import Counter, defaultdict

import pytest

from promptloom.operators import terms
from promptloom.operators.summary import tokenize

ROWS = [
    (1, 0, "Fast engines compress long prompts"),
    (1, 1, "engines, engines and more engines"),
    (1, 2, "the of and"),
    (1, 3, "don’t compress Prompts twice"),
    (2, 0, "alone"),
    (3, 0, None),
    (3, 1, ""),
    (4, 0, "one line of an id"),
    (4, 0, "another line of that id, of another length"),
    (None, 0, "engines without a document"),
    (None, 1, "engines again"),
]


def plain(rows):
    by = defaultdict(list)
    for d, s, t in rows:
        if d is not None:
            by[d].append((s, tokenize(t or "")))
    out = {}
    for d, lines in by.items():
        found = Counter((s, len(w), t) for s, w in lines for t in w)
        df = Counter(t for _, _, t in found)
        weight = [(s, t, n / size * (math.log((1 + len(lines)) / (1 + df[t])) + 1)) for (s, size, t), n in found.items()]
        mean = Counter()
        for _, t, w in weight:
            mean[t] += w / len(lines)
        norm = math.sqrt(sum(m * m for m in mean.values()))
        for s in {s for s, _, _ in weight}:
            own = [(t, w) for x, t, w in weight if x == s]
            out[d, s] = sum(w * mean[t] for t, w in own) / math.sqrt(sum(w * w for _, w in own)) / norm
    return out


def test_centroid_cosine(spark):
    got = terms.centroid_cosine(spark.createDataFrame(ROWS, "doc_id long, line_no long, text string"), "doc_id", "line_no").collect()
    want = plain(ROWS)
    assert len(got) == len(want) and {(r.doc_id, r.line_no): r.cosine for r in got} == pytest.approx(want)


def test_sentences_are_dealt_out_once(spark, small):
    from promptloom.plans.catalog import QUERIES

    plan = QUERIES["sentence_centroid"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
