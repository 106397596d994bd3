import re
from collections import Counter

from promptloom.llm import qualityrules, queries
from promptloom.llm.shared import written


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(wins), set()
    for i, w in enumerate(wins):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics(spark, small, texts, odd, none):
    for r in queries.op10_qualityrules(spark, small).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rule == 0)
    rows = qualityrules.counted(odd).collect()
    source = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    assert all(tuple(r)[1:] == brute(source[r.doc_id]) for r in rows)
    assert qualityrules.counted(none).count() == 0


def test_hard_texts(spark):
    hard = ["a b c a b c", "a a a a", "a\x0bb\x0cc\rd", "\u00a0 x\u2003y", "l\nl\n l\nl\n\n\n", "a b\nc", "a|b #$%&<>* x", "a b c d a b", " ", "\n\n"]
    got = qualityrules.counted(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [brute(t) for t in hard]


def cells(rows, edges):
    cube = Counter()
    for i, (features, bad) in enumerate(rows):
        place = tuple(sum(v > e for e in edges[f]) for f, v in features.items())
        cube[i % 3 == 0, place, bad] += 1
    return [(h, p, cube[h, p, True], cube[h, p, False]) for h, p in {(h, p) for h, p, _ in cube}]


def test_covering_finds_a_conjunction():
    rows = [({"a": i % 10, "b": i % 7}, i % 10 > 6 and i % 7 > 3) for i in range(2000)]
    edges = {"a": [float(k) for k in range(10)], "b": [float(k) for k in range(7)]}
    rules = qualityrules.covering(cells(rows, edges), edges, 0.95, 10, 8)
    assert len(rules) == 1 and sorted(rules[0]) == [("a", ">", 6.0), ("b", ">", 3.0)]


def test_nothing_to_learn(spark, odd):
    edges = {"a": [1.0]}
    assert qualityrules.covering([], edges, 0.9, 1, 4) == []
    assert qualityrules.covering(cells([({"a": i % 3}, i % 2 == 0) for i in range(600)], edges), edges, 0.95, 10, 8) == []
    stats = qualityrules.counted(odd)
    assert qualityrules.learned(stats, spark.createDataFrame([], "doc_id long, quality int")) == []
    judged = qualityrules.judged(stats, []).collect()
    assert all(r.kept == (not r.base_failed) for r in judged)


def test_learned_rules_reject_symbols(spark, small):
    folder = small.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    stats = written(qualityrules.counted(docs), "stats")
    rules = qualityrules.learned(stats, labels)
    assert rules
    judged = qualityrules.judged(stats, rules).join(labels, "doc_id").where("not base_failed")
    bad = judged.where("quality = 0")
    good = judged.where("quality = 1")
    assert bad.where("not kept").count() > 0.8 * bad.count() and good.where("not kept").count() < 0.01 * good.count()


def test_plan_is_native(odd):
    plan = qualityrules.judged(qualityrules.counted(odd), [[("words", ">", 5.0)]])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
