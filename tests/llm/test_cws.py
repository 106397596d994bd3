import hashlib
from collections import Counter

import numpy as np

from promptloom.llm import cws, ordered, queries


def bag(text):
    return Counter(text.encode().lower().split())


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(12):
        words = [f"w{i}" for i in range(30)]
        a = " ".join(w for w in words for _ in range(rng.integers(0, 6)))
        b = " ".join(w for w in words for _ in range(rng.integers(0, 6)))
        x, y = cws.signatures([a.encode(), b.encode()], 4096)
        assert abs(cws.likeness(x, y) - jaccard(a, b)) < 0.03


def check(got, rows):
    """rows: (id, text) in order."""
    texts = [t or "" for _, t in rows]
    behind = texts[1:] + texts[:1]
    edits = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, behind)]
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, _), t, e in zip(rows, texts, edits))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    sig = dict(zip(texts + edits, cws.signatures([t.encode() for t in texts + edits], 64)))
    likely = sorted((str(i), sig[t].hex(), sig[e].hex(), cws.likeness(sig[t], sig[e]), cws.likeness(sig[t], sig[n])) for (i, _), t, e, n in zip(rows, texts, edits, behind))
    assert sorted((str(r.doc_id), r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == likely


def test_query_against_brute_force(spark, small, texts, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE", 1 << 14)
    got = queries.op5_cws(spark, small).collect()
    check(got, sorted(texts.items()))
    error = np.array([r.near_edited for r in got]) - np.array([jaccard(texts[r.doc_id], texts[r.doc_id][: len(texts[r.doc_id]) - len(texts[r.doc_id]) // 4]) for r in got])
    assert abs(error.mean()) < 0.2


def test_odd_rows(odd, none, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    order.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    for size in (1 << 21, 1 << 10):
        monkeypatch.setattr(ordered, "RANGE", size)
        check(cws.fingerprinted(odd).collect(), order)
    assert cws.fingerprinted(none).count() == 0
    one = cws.fingerprinted(odd.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def test_empty_texts_are_alike():
    assert cws.likeness(b"", b"") == 1.0 and cws.likeness(b"", b"ab") == 0.0
