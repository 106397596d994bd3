"""Matches clear of hazards, against a plain version."""

import re
import time

import numpy as np
import pytest

from promptloom.operators import lines
from promptloom.plans import catalog

WORD = "[A-Za-z0-9.]+"
ROWS = [
    (1, "write ada@example.com or x@y.zz now \U0001f600 été done"),
    (2, "no address here"),
    (2, "but b@example.org in another row of the same id"),
    (3, None),
    (4, ""),
    (5, " \n"),
    (None, "c@example.com has no id"),
]


def plain(rows, hazards):
    spans = [(k, m.start(), m.end(), m[0]) for k, t in rows for m in re.finditer(WORD, t or "")]
    return [s for s in spans if not any(k == s[0] and k is not None and a < s[2] and b > s[1] for k, a, b in hazards)]


def test_matches_clear_of_hazards(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    hazards = [(k, m.start(), m.end()) for k, t in ROWS for m in re.finditer(catalog.EMAIL, t or "")] + [(2, 0, 4), (2, 2, 3), (4, 0, 9)]
    found = lines.matches_of(rows, "doc_id", "text", WORD, spark.createDataFrame(hazards, "doc_id long, start long, end long"))
    assert found.columns == ["doc_id", "start", "end", "match"]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, plain(ROWS, hazards)))
    assert sorted(map(repr, (tuple(r) for r in lines.matches_of(rows, "doc_id", "text", WORD).collect()))) == sorted(map(repr, plain(ROWS, [])))
    assert lines.matches_of(rows.limit(0), "doc_id", "text", WORD).count() == 0


@pytest.mark.parametrize("n", [0, 1, 40])
def test_overlapped(n):
    rng = np.random.default_rng(n)
    start, starts = rng.integers(0, 300, 200), rng.integers(0, 300, n)
    end, ends = start + rng.integers(1, 9, 200), starts + rng.integers(1, 30, n)
    want = [any(a < e and b > s for a, b in zip(starts, ends)) for s, e in zip(start, end)]
    assert lines.overlapped(start, end, starts, ends).tolist() == want


def test_many_matches_and_hazards_in_one_text(spark, tmp_path):
    """Time in proportion to matches, not to their square."""
    text = "some words round a@example.com again " * 30_000
    spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    assert catalog.QUERIES["range_overlap_anti_join"](spark, str(tmp_path)).count() == 4 * 30_000
    assert time.time() - began < 30
