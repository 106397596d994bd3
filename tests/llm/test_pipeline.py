import corpus_pipeline as cp
import pytest

from promptloom.llm import langid, secretscan


@pytest.fixture(scope="module")
def stages(spark, small):
    """Documents before and after every stage, each written and read again."""
    from promptloom.llm.shared import written

    out = [spark.read.parquet(f"{small}/documents.parquet")]
    for _, f in cp.STAGES:
        out.append(written(f(spark, out[-1], small), "stage"))
    return out


def test_stages(stages, spark, small):
    documents, known, single, masked, mixed, pieces = stages
    for s in (known, single, masked, mixed):
        assert s.columns == documents.columns and s.dtypes == documents.dtypes
    model = langid.trained(documents)
    rejected = {r.doc_id for r in langid.identify(documents, model).where("rejected").collect()}
    ids = lambda s: {r.doc_id for r in s.select("doc_id").collect()}
    assert ids(known) == ids(documents) - rejected
    before = {r.doc_id: r.text for r in single.collect()}
    net = secretscan.trained(single)
    for r in masked.collect():
        spans = secretscan.spans_of([before[r.doc_id]], net)[0]
        assert (r.text != before[r.doc_id]) == bool(spans) and r.n_chars == len(r.text)
        assert secretscan.base_spans(r.text) == []
    assert ids(mixed) <= ids(masked) and ids(pieces) == ids(mixed)
    assert mixed.count() == pieces.count() and pieces.where("not lossless").count() == 0


def test_clean_documents_stay(stages, spark, small):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    before, after = stages[3], {r.doc_id for r in stages[4].select("doc_id").collect()}
    clean = [r.doc_id for r in before.select("doc_id").collect() if labels.get(r.doc_id) == (1, 0)]
    assert sum(i in after for i in clean) >= 0.98 * len(clean)


def test_run(spark, small):
    got = cp.run(spark, small)
    assert set(got.columns) >= {"doc_id", "ids", "n_pieces"} and got.count() > 100
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5


def test_odd_rows(spark, odd, none, small, tmp_path):
    """All columns of the fixture, those that clash with the stages' own among them, go through with their values."""
    marks = spark.createDataFrame([(1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    from promptloom.llm.shared import written

    extra = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert {"copy", "copies", "rate", "kept_id", "decided_id"} <= set(extra)
    for rows in (odd, none):
        docs = rows
        for _, f in cp.STAGES[:-1]:
            docs = written(f(spark, docs, str(tmp_path)), "odd")
            assert docs.columns == odd.columns
            assert all(r[c] == "?" for r in docs.collect() for c in extra)
        assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    one = cp.near_duplicates(spark, odd, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in one if r.doc_id is not None).count(4) == 0 and any(r.doc_id is None for r in one)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    return frozenset([b" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([b" ".join(words)] if words else []))


def test_near_duplicates_against_brute_force(stages):
    """Of all pairs the exact similarity of the sets of five-word shingles; components by repeated least labels."""
    sets = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    label, changed = {i: i for i in sets}, True
    pairs = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and (x == y or len(x & y) >= 0.8 * len(x | y))]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed = changed or (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({*label.values()})


def test_copies_and_pieces_against_plain_ones(stages, spark, small):
    """The mixing stage's copies from the rates, one document at a time; the pieces spell each text."""
    import hashlib
    from collections import Counter

    from promptloom.llm import mixing

    rates = {r.doc_id: r for r in mixing.weighted(stages[3], spark.read.parquet(f"{small}/labels.parquet"), factors=cp.FACTORS).collect()}
    assert Counter(r.doc_id for r in stages[4].select("doc_id").collect()) == Counter({i: r.copies for i, r in rates.items() if r.copies})
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rates.values())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in stages[5].collect())
