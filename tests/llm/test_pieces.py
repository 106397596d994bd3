import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from promptloom.llm import pieces, queries
from promptloom.llm.shared import byte_rows


@pytest.fixture(scope="module")
def voc():
    return pieces.vocabulary()


def run(voc, texts, keys, seed=0):
    data, offsets = byte_rows(pa.array(texts, pa.string()))
    ids, counts = pieces.encode(voc, data, offsets, np.array(keys, np.int64), seed)
    back, ends = pieces.decode(voc, ids, counts)
    split = np.split(ids, np.cumsum(counts)[:-1])
    return [x.tolist() for x in split], [back[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])]


TEXTS = ["hello world", "  two  spaces\n\ttab", "", " ", "x ", "\u2581lit\u2581eral x", "h\u00e9llo \u65e5\u672c\u8a9e \U0001f600 \x00", "a" * 5000, "hello world", " " * 100, "word " * 2000, "\u2581"]


def test_lossless_and_reproducible(voc):
    keys = list(range(len(TEXTS)))
    ids, back = run(voc, TEXTS, keys)
    assert back == TEXTS
    for k, t in enumerate(TEXTS):  # alone as in a batch
        assert run(voc, [t], [k])[0][0] == ids[k]
    assert run(voc, TEXTS, keys, seed=1)[0] != ids


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate({97: "b", 98: "a"})
    return out[:n]


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_chunks_whose_hashes_collide(voc, n):
    """Thue-Morse strings and their complements have equal polynomial hashes modulo 2^64; bytes decide."""
    texts = [thue_morse(n), thue_morse(n).translate({97: "b", 98: "a"}), "ab", thue_morse(n), thue_morse(n).translate({97: "b", 98: "a"}) + " ab"]
    chunks = np.frombuffer((" " + " ".join(texts[:2])).encode(), np.uint8)
    assert len(set(pieces.chunk_hashes(chunks, np.array([0, n + 1]), np.array([n + 1, n + 1])).tolist())) == 1
    ids, back = run(voc, texts, range(5))
    assert back == texts
    for k, t in enumerate(texts):
        assert run(voc, [t], [k])[0][0] == ids[k]


def test_sampled_frequencies(voc):
    spell = lambda i: bytes(voc.data[voc.starts[i] : voc.starts[i] + voc.sizes[i]])
    lookup = {spell(i): i for i in range(len(voc.sizes)) if voc.sizes[i] and i not in set(voc.byte_id.tolist())}

    def every(s):
        if not s:
            yield ()
        for j in range(1, len(s) + 1):
            if s[:j] in lookup:
                for rest in every(s[j:]):
                    yield (lookup[s[:j]], *rest)

    paths = list(every(b" hello"))
    weight = np.array([math.exp(sum(voc.score[i] for i in p)) for p in paths])
    n = 20_000
    seen = Counter(map(tuple, run(voc, ["hello"] * n, range(n))[0]))
    assert set(seen) <= set(paths)
    for p, w in zip(paths, weight / weight.sum()):
        assert abs(seen[p] / n - w) < 4 * math.sqrt(w * (1 - w) / n) + 1e-3


def test_forward_filter_is_the_partition_sum(voc):
    text = np.frombuffer(b" hello", np.uint8)
    lattice = pieces.Lattice(voc, text, np.array([0]), np.array([6]))
    total = {0: 1.0}
    spell = {bytes(voc.data[s : s + n]): i for i, (s, n) in enumerate(zip(voc.starts, voc.sizes)) if n and i not in set(voc.byte_id.tolist())}
    for end in range(1, 7):
        total[end] = sum(total[a] * math.exp(voc.score[spell[b" hello"[a:end]]]) for a in range(end) if b" hello"[a:end] in spell)
    assert math.isclose(lattice.log_total[0], math.log(total[6]), rel_tol=1e-9)


def test_query_and_odd_rows(spark, small, texts, odd, none, voc):
    got = {r.doc_id: r for r in queries.op7_pieces(spark, small).collect()}
    for i, t in texts.items():
        r = got[i]
        assert r.lossless and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.n_pieces == len(r.ids)
    rows = pieces.segmented(odd, voc).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and all(r.lossless for r in rows)
    assert by[2].ids is None and by[2].n_pieces == 0 and by[3].ids == []
    four = [r.ids for r in rows if r.doc_id == 4]
    assert four[0] == four[1]
    assert pieces.segmented(none, voc).count() == 0
