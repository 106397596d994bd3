import numpy as np
import pytest
import xxhash

from promptloom.llm import queries, simhash
from promptloom.llm.shared import components


def brute_fingerprint(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius):
    label = dict(zip(ids, ids))
    near = [(a, b) for a, x in zip(ids, fps) for b, y in zip(ids, fps) if a < b and (x ^ y).bit_count() <= radius]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


def test_query_against_brute_force(spark, small, texts):
    got = {r.doc_id: r for r in queries.op2_simhash(spark, small).collect()}
    fps = {i: brute_fingerprint(t, 4) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    want = brute_components(list(fps.values()), list(fps), 4)
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("limits, parts", [((4, 4, 8192, 1 << 20, 256), 4), ((16, 8, 3, 10, 2), 4), ((64, 16, 8192, 1 << 20, 4), 3), ((64, 16, 8192, 1 << 20, 4), 2), ((2048, 16, 4096, 16384, 256), 1)])
def test_links_of_random_clusters(spark, monkeypatch, limits, parts):
    for name, value in zip(("LEAF", "SAMPLES", "HOMES", "ROWS", "INNER"), limits):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(simhash, "parts_for", lambda n, radius: parts)
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(30):
        center = int(rng.integers(0, 2**63))
        for _ in range(10):
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                center ^= 1 << int(b)
            fps.append(center)
    fps = sorted(set(fps))
    ids = list(range(len(fps)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    reps = spark.createDataFrame(list(zip(signed, ids)), "fp long, first long")
    found = {r.node: r.component for r in components(simhash.links(reps, 4)).collect()}
    assert {i: found.get(i, i) for i in ids} == brute_components(fps, ids, 4)


@pytest.mark.parametrize("radius, parts", [(4, 4), (4, 5), (4, 3), (3, 4), (2, 5), (6, 4)])
def test_parts_cover_every_pair(radius, parts):
    cut = simhash.parts_of(radius, parts)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any((diff & mask).bit_count() <= r for mask, r in cut)


def test_trees_at_every_size_and_parts_that_widen():
    rng = np.random.default_rng(1)
    few = rng.integers(0, 2**63, 32, dtype=np.uint64)
    assert simhash.grow(few, 0xFFFF, simhash.SHALLOW + 2, rng) is not None
    assert [simhash.parts_for(n, 4) for n in (1, 10**6, 10**9, 10**12)] == [4, 4, 3, 2]
    # a tree over the rows themselves prunes: fewer comparisons than all pairs, none lost
    fps = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    homes = np.ones(len(fps), bool)
    met = list(simhash.within(fps, homes, 0xFFFF, 1, 4))
    assert len(met) > 8 and sum(int(h.sum()) * len(r) for r, h in met) < 0.8 * len(fps) ** 2
    assert sum(int(h.sum()) for _, h in met) == len(fps)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd, shingle=4).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[4]) == 2 and {r.component_id for r in by[4]} == {1} and by[1][0].component_id == 1
    assert by[2][0].fp == by[3][0].fp == by[5][0].fp == 0
    assert by[3][0].component_id == by[5][0].component_id == by[2][0].component_id == 2
    assert by[None][0].component_id is None and by[None][0].fp != 0
    assert simhash.near_duplicates(none).count() == 0


def brute_similar(texts, n, least):
    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
        return frozenset([b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else []))

    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    pairs = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and (x == y or len(x & y) >= least * len(x | y))]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("limits", [(200_000, 250_000, 500_000), (3, 50, 10)])
def test_similarity_against_brute_force(spark, small, texts, monkeypatch, limits):
    monkeypatch.setattr(simhash, "COMMON", limits[0])
    monkeypatch.setattr(simhash, "TOKENS", limits[1])
    monkeypatch.setattr(simhash, "WANTED", limits[2])
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(400)]
    common = list(rng.choice(vocabulary, 12))
    made = {}
    for _ in range(25):
        base = list(rng.choice(vocabulary, rng.integers(3, 160))) + common
        for _ in range(6):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 4)):
                words[at] = str(rng.choice(vocabulary))
            made[10_000_000 + len(made)] = " ".join(words)
    rows = {**texts, **made}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    want = brute_similar(rows, 5, 0.8)
    assert got == want and len(set(want.values())) < len(want)
    apart = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, similarity=None).collect()}
    assert sum(want[i] != apart[i] for i in made) > 20


def test_a_group_is_spanned_not_expanded(spark):
    """Sets that share a shingle and are all alike make fewer pairs than there are sets, in whatever bits they differ."""
    rng = np.random.default_rng(6)
    base = rng.choice(2**60, 100, replace=False)
    sets = [np.unique(np.concatenate([base[4:], rng.choice(2**60, 4)])).view(np.uint64) for _ in range(60)]
    sets += [np.unique(np.concatenate([base[:1], rng.choice(2**60, 99)])).view(np.uint64) for _ in range(60)]  # share a shingle, else apart
    reps = spark.createDataFrame([(k, bytearray(simhash.parities(x, simhash.SHORT))) for k, x in enumerate(sets)], "key long, fold binary")
    shared = spark.createDataFrame([(t, k, len(x), 0) for k, x in enumerate(sets) for t in (5, 6, 7)], "token long, key long, n int, at int")
    labels = spark.createDataFrame([], "node long, component long")
    span = [tuple(r) for r in simhash.pairs_apart(shared, labels, reps, 0.8, spanning=True).collect()]
    every = {tuple(r) for r in simhash.pairs_apart(shared, labels, reps, 0.8).collect()}
    alike = {(a, b) for a in range(60) for b in range(a + 1, 60)}
    assert every == alike  # parities rule the others out
    assert set(span) <= every and len(span) <= 3 * 59
    found = {r.node: r.component for r in components(spark.createDataFrame(span, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(60)}
