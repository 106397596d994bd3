import binascii
import re

import numpy as np

from promptloom.llm import langid, queries


def test_held_out_accuracy(spark, small, docs):
    got = {r.doc_id: r for r in queries.op3_langid(spark, small).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == truth.keys()
    for i, r in got.items():
        assert r.held_out == (binascii.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) >= 0.97


def test_training_ignores_held_out_rows(spark, docs):
    poisoned = docs.selectExpr("doc_id", "text", "CASE WHEN pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 THEN 'zz' ELSE lang END AS lang")
    assert "zz" not in langid.trained(poisoned, per_lang=50)["names"]


def test_odd_rows(odd, none, docs):
    model = langid.trained(docs, per_lang=50)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    for i in (2, 3, 5, 6):
        assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    assert rows[7].lang_pred in model["names"] and rows[None].lang_pred in model["names"]
    assert langid.identify(odd, model).count() == odd.count()
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and not {2, 3, 5, 6} & {r.doc_id for r in kept.collect()}
    assert langid.identify(none, model).count() == 0
    assert langid.trained(none) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_grams_stay_within_rows():
    one = lambda t: sorted(langid.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 1 << 16)[0].tolist())
    data = b"ab cdeFg"
    offsets = np.array([0, 2, 2, 8])
    bucket, row = langid.grams(np.frombuffer(data, np.uint8), offsets, 1 << 16)
    for k in range(3):
        assert sorted(bucket[row == k].tolist()) == one(data[offsets[k] : offsets[k + 1]])
    assert one(b"Ab  1 c") == one(b"ab c")


def test_prediction_does_not_depend_on_batches(docs):
    model = langid.trained(docs, per_lang=50)
    a = {r.doc_id: r.score for r in langid.identify(docs, model).collect()}
    b = {r.doc_id: r.score for r in langid.identify(docs.repartition(7), model).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_scores_against_a_plain_forward_pass(docs):
    """Every n-gram of every word between spaces, one at a time, in Python integers."""
    model = langid.trained(docs, per_lang=50)
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def plain(text):
        raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.lower().encode() + b" ") if text.isascii() else re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()) + b" ")
        total, count = np.zeros(len(model["names"])), 0
        for size in langid.SIZES:
            for at in range(len(raw) - size + 1):
                gram = raw[at : at + size]
                if b" " not in gram[1:-1]:
                    total, count = total + model["table"][mixed(int.from_bytes(bytes([size]) + gram, "big") & mask) % len(model["table"])], count + 1
        z = (total / max(count, 1) + model["bias"]) / model["temperature"]
        e = np.exp(z - z.max())
        return e / e.sum()

    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").limit(40).collect()}
    for r in langid.identify(docs.where(docs.doc_id.isin(list(texts))), model).collect():
        p = plain(texts[r.doc_id])
        assert r.lang_pred == model["names"][int(p.argmax())] and abs(r.score - p.max()) < 1e-6
        assert r.rejected == (r.score < model["threshold"])


def test_rare_labels_are_learned(spark):
    rows = [(i, f"word{i % 600} text {i}", f"l{i % 600:03d}") for i in range(3000)]
    texts, langs = langid.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10)
    assert len(set(langs)) == 600


def test_repeated_rows_and_ties(spark, docs):
    model = langid.trained(docs, per_lang=50)
    got = langid.identify(docs.limit(20).unionByName(docs.limit(20)), model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(got) == 40 and all(len(x) == 1 for x in by.values())
    flat = model | {"table": np.zeros_like(model["table"]), "bias": np.zeros_like(model["bias"])}
    assert {r.lang_pred for r in langid.identify(docs.limit(5), flat).collect()} == {model["names"][0]}
