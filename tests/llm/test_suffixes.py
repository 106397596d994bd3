import hashlib

import numpy as np
import pytest

from promptloom.llm import queries, shared, suffixes


def brute(rows, length=100):
    """rows: texts in order -> (n_bytes, n_removed, n_spans, sha)."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def columns(r):
    return r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256


TINY = {"RANGE": 1 << 12, "HOT": 1, "LED": 2, "BLOCK": 20, "BUCKET": 500, "COMMON": 3, "SEEN": 3, "SMALL": 2}


@pytest.mark.parametrize("limits", [{}, TINY])
def test_query_against_brute_force(spark, small, texts, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    got = {r.doc_id: columns(r) for r in queries.op6_suffixes(spark, small).collect()}
    ids = sorted(texts)
    assert [got[i] for i in ids] == brute([texts[i] for i in ids])


@pytest.mark.parametrize("limits", [{}, TINY])
def test_shared_passages_and_periods(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefgh \u00e9"), n))
    passage = word(260)
    rows = [word(rng.integers(0, 150)) + passage[a : a + rng.integers(95, 200)] + word(rng.integers(0, 150)) for a in rng.integers(0, 60, 40)]
    rows += ["ab" * 150, "a" * 99, "a" * 100, "a" * 350, "*" * 101, passage * 3, "", passage[:100], passage[:99]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffixes.cleaned(frame).collect()}
    assert [columns(got[i]) for i in range(len(rows))] == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.values())


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate({97: "b", 98: "a"})
    return out[:n]


def test_strings_whose_hashes_collide(spark):
    """Thue-Morse strings and their complements have equal polynomial hashes modulo 2^64; bytes decide."""
    rows = []
    for n in (1024, 2048, 4096):
        rows += [thue_morse(n), thue_morse(n).translate({97: "b", 98: "a"}), "x" * 30 + thue_morse(n)]
    for parts, length in ((1, 1024), (4, 1024), (3, 100)):
        frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(parts)
        got = {r.doc_id: columns(r) for r in suffixes.cleaned(frame, length=length).collect()}
        assert [got[i] for i in range(len(rows))] == brute(rows, length)


def test_lengths(spark):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefgh"), 900))
    rows = [long, "y" + long[100:700], long[:450] + "z" + long[450:]]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for length in (40, 295, 400):
        got = {r.doc_id: columns(r) for r in suffixes.cleaned(frame, length=length).collect()}
        assert [got[i] for i in range(3)] == brute(rows, length)
    for length in (39, 30_001):
        with pytest.raises(ValueError):
            suffixes.cleaned(frame, length=length)


def test_odd_rows(odd, none):
    got = suffixes.cleaned(odd).collect()
    assert len(got) == odd.count() and suffixes.cleaned(none).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(columns(r))
    assert by[2] == by[3] == [(0, 0, 0, hashlib.sha256(b"").hexdigest())]
    assert by[8] == [(70_000, 69_999 - 99 + 99, 1, hashlib.sha256(b"x").hexdigest())]
    assert by[4][0] == by[4][1]  # rows equal in id and text are one document


@pytest.mark.parametrize("n", [0, 1, 2, 500, 5000])
def test_multikey_sort(n):
    rng = np.random.default_rng(2)
    for words in (rng.integers(0, 3, (n, 5)), rng.integers(0, 2**62, (n, 2)), np.zeros((n, 3), int), np.sort(rng.integers(0, 50, (n, 1)), axis=0)):
        words = words.astype(np.uint64)
        order, head = suffixes.multikey(words)
        want = sorted(range(n), key=lambda i: (tuple(words[i]), i))
        assert order.tolist() == want
        assert head.tolist() == [k == 0 or tuple(words[want[k]]) != tuple(words[want[k - 1]]) for k in range(n)]


def test_workers_give_memory_back(spark, monkeypatch):
    """Every Python function that the operator sends out is one that gives freed memory back after its task or group."""
    sent = []
    kinds = (type(spark.range(1)), "mapInArrow"), (type(spark.range(1).groupBy("id")), "applyInArrow")
    for kind, name in kinds:
        monkeypatch.setattr(kind, name, lambda self, run, *a, f=getattr(kind, name), **b: sent.append(run.__qualname__) or f(self, run, *a, **b))
    for name, value in TINY.items():
        monkeypatch.setattr(suffixes, name, value)
    assert suffixes.cleaned(spark.createDataFrame([(i, "abcdefgh " * 40 + str(i)) for i in range(20)], "doc_id long, text string")).count() == 20
    assert len(sent) >= 5 and {x.split(".")[0] for x in sent} == {"frugal", "frugal_group"}


def test_memory_goes_back_after_each_group(monkeypatch):
    back = []
    monkeypatch.setattr(shared, "given_back", lambda: back.append(1))
    group = shared.frugal_group(lambda table: table * 2)
    assert [group(k) for k in (1, 2)] == [2, 4] and len(back) == 2
