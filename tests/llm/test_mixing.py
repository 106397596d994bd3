import re

import numpy as np
import pytest

from promptloom.llm import mixing, queries


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/labels.parquet")


@pytest.fixture(scope="module")
def more(spark, small):
    return spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")


def test_targets_are_met(more, labels):
    rows = mixing.weighted(more, labels, weights=queries.WEIGHTS).collect()
    assert len(rows) == 1000
    p = np.array([r.posterior for r in rows])
    n = np.array([r.n_tokens for r in rows])
    rate = np.array([r.rate for r in rows])
    names = mixing.trained(more, labels)["names"]
    want = np.array([queries.WEIGHTS.get(x, 0) for x in names])
    want = want / want.sum() * n.sum()
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.abs((p * (n * rate)[:, None]).sum(axis=0) - want).max() < 0.01 * n.sum()
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


def test_rates_against_a_plain_solver(spark):
    """Projected gradient without momentum, in one process, on the same numbers, until it stands still."""
    rng = np.random.default_rng(4)
    for alpha, share in (([0.5] * 3, [0.7, 0.25, 0.05]), ([20.0, 18.0, 5.0], [0.5, 0.46, 0.04]), ([6.0, 5.0, 4.0], [0.55, 0.3, 0.15])):
        p = rng.dirichlet(alpha, 300)
        n = rng.integers(1, 500, 300)
        frame = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(300)], "doc_id long, n_tokens long, p array<double>")
        goal = np.array(share) * n.sum()
        steps, totals, target = mixing.solved(frame.coalesce(2), 3, lambda t: goal)
        gram = (p * n[:, None]).T @ p
        inverse, r = np.linalg.inv(gram), np.ones(300)
        for _ in range(20_000):
            r = np.maximum(0, r - p @ (inverse @ ((r * n) @ p - goal)))
        assert np.allclose(mixing.rates_after(p, steps)[0] * n @ p, totals) and np.abs(totals - (r * n) @ p).max() < 1e-4 * n.sum()
        # where the targets are out of reach the nearest totals count: the gradient of every positive rate is nought
        slope, rate = p @ (inverse @ (totals - goal)), mixing.rates_after(p, steps)[0]
        assert np.abs(slope[rate > 1e-3]).max() < 1e-3 and (slope[rate <= 1e-3] > -1e-3).all()


def test_posteriors_against_a_plain_forward_pass(more, labels):
    model = mixing.trained(more, labels)
    rows = {r.doc_id: r.text for r in more.limit(60).collect()}
    for r in mixing.posteriors(more.where(more.doc_id.isin(list(rows))), model).collect():
        raw = rows[r.doc_id].encode()
        runs = re.findall(rb"[a-z\x80-\xff]+", raw.lower())
        z = np.array(model["bias"], float)
        found = {int(mixing.words_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1][0]) for w in set(runs)}
        for bucket in found:
            if model["place"][bucket] >= 0:
                z = z + model["words"][model["place"][bucket]]
        tokens = len(raw.split())
        symbols = sum(raw.count(c) for c in b"#*$%&|<>")
        repeats = sum(a == b for a, b in zip(runs, runs[1:]))
        t = max(tokens, 1)
        z = z + np.array([np.log1p(tokens) / 5, np.log1p(100 * symbols / t) / 3, np.log1p(100 * repeats / t) / 3, float(symbols > 0)]) @ model["figures"]
        e = np.exp(z - z.max())
        assert r.n_tokens == tokens and np.allclose(r.p, e / e.sum(), atol=1e-9)


def test_classifier(more, labels):
    model = mixing.trained(more, labels)
    truth = {r.doc_id: f"q{r.quality}t{r.toxic}" for r in labels.collect()}
    rows = mixing.posteriors(more, model).collect()
    right = [model["names"][int(np.argmax(r.p))] == truth[r.doc_id] for r in rows if r.doc_id in truth]
    assert np.mean(right) > 0.9
    again = {r.doc_id: r.p for r in mixing.posteriors(more.repartition(5), model).collect()}
    assert all(np.allclose(again[r.doc_id], r.p) for r in rows)


def test_words_and_tokens():
    texts = [b"", b"Ab ab, c!", b" \n", b"x", b"\xc3\xa9t\xc3\xa9 y"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, bucket, tokens, figures = mixing.words_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert tokens.tolist() == [0, 3, 0, 1, 2] and row.tolist() == [1, 1, 1, 3, 4, 4]
    assert bucket[0] == bucket[1] != bucket[2] and len(figures) == 5


def test_odd_rows(spark, odd, none, labels):
    marks = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 1, 0), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.weighted(odd, marks, weights={"q1t0": 1.0}).collect()
    assert len(rows) == odd.count() and all(r.rate >= 0 for r in rows)
    four = [(r.rate, r.copies) for r in rows if r.doc_id == 4]
    assert four[0] == four[1]
    alone = mixing.weighted(odd, marks.where("false")).collect()
    assert {(r.domain, r.rate, r.copies) for r in alone} == {("all", 1.0, 1)}
    assert mixing.weighted(none, marks).count() == 0
