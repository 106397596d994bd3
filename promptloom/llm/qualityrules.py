"""Quality rules: text statistics in Spark expressions and a learned decision list over them.

Training aggregates, in Spark, the labelled rows into a cube: every statistic cut at quantiles, counts by
label in two halves (by a hash of the id). Sequential covering then works on that bounded cube: it grows
a conjunction of thresholds by FOIL gain on the growing half, prunes it on the other half, emits it if it
still rejects precisely enough, takes away what it covers and goes on; where it does not, the next best first condition
is tried. The list becomes one ordered CASE expression. All of it are DataFrame functions; the driver sees only the
cube: 15 cuts a statistic and two halves bound it by 2 * 16^5 cells, and the labelled rows do.

Defined results. Null or empty text: no words, so base_failed and not kept. Null doc_id: judged all the
same, never joined to a label. Repeated rows: each is judged. No labels, or labels of one kind: an empty
list, so the base decides. Labels that repeat an id: the least. Ties between conditions: the first by statistic, cut and
side. Very long texts: whole, their windows in the memory of a task. Empty table: no rows. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # each window with its place, sorted, so that equal ones are neighbours; equal means equal text
    window = F.when(
        F.size("words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))),
            lambda i: F.struct(F.concat_ws(" ", F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]).alias("g"), i.alias("i")),
        ),
    ).otherwise(F.expr("cast(array() as array<struct<g:string,i:int>>)"))
    sized = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.length(F.concat_ws("", "words")), F.lit(0)).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(window).alias("windows"),
    )
    # places of windows found twice or more, by one pass over the sorted windows
    twice = sized.withColumn(
        "places",
        F.sort_array(
            F.transform(
                F.filter("windows", lambda x, k: ((k > 0) & (F.get(F.col("windows"), k - 1)["g"] == x["g"])) | F.coalesce(F.get(F.col("windows"), k + 1)["g"] == x["g"], F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return twice.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What a rule may ask of: ratios, so that thresholds mean the same for short and long texts.
FEATURES: dict[str, str] = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
}


def learned(stats: DataFrame, labels: DataFrame, label: str = "quality", bins: int = 8, min_precision: float = 0.95, min_cover: int = 10, max_rules: int = 12) -> list[list[tuple[str, str, float]]]:
    """The decision list: each rule a conjunction of (feature, '>' or '<=', threshold) that rejects. It learns from rows that pass the base."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"))
    rows = stats.where(~base_failed()).join(known, "doc_id").select("y", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("half"), *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    share = [k / bins for k in range(1, bins)] + [0.95, 0.98, 0.99, 0.995]
    cuts = rows.agg(*(F.percentile_approx(f, [0.005, 0.01, 0.02, 0.05, *share], 10_000).alias(f) for f in FEATURES)).first()
    edges = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    if not any(edges.values()):
        return []
    place = lambda f: sum((F.when(F.col(f) > F.lit(e), 1).otherwise(0) for e in edges[f]), F.lit(0))
    cube = rows.groupBy("half", *(place(f).alias(f) for f in FEATURES)).agg(F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, 0).otherwise(1)).alias("good"))
    # a threshold stands halfway to the next value that a labelled row has
    above = rows.agg(*(F.min(F.when(F.col(f) > F.lit(e), F.col(f))).alias(f"{f}{k}") for f in FEATURES for k, e in enumerate(edges[f]))).first()
    middle = {f: [e if above[f"{f}{k}"] is None else (e + above[f"{f}{k}"]) / 2 for k, e in enumerate(edges[f])] for f in FEATURES}
    cells = [(bool(r["half"]), tuple(r[f] for f in FEATURES), r["bad"], r["good"]) for r in cube.collect()]
    return covering(cells, middle, min_precision, min_cover, max_rules)


def covering(cells: list[tuple[bool, tuple[int, ...], int, int]], edges: dict[str, list[float]], min_precision: float, min_cover: int, max_rules: int) -> list[list[tuple[str, str, float]]]:
    """Sequential covering on the cube: grow by FOIL gain on one half, prune on the other (True)."""
    if not cells:
        return []
    names = list(edges)
    tests = [(k, op, at) for k, f in enumerate(names) for at in range(len(edges[f])) for op in (">", "<=")]
    prune = np.array([c[0] for c in cells])
    place = np.array([c[1] for c in cells]).reshape(len(cells), len(names))
    bad, good = (np.array([c[i] for c in cells], np.int64) for i in (2, 3))
    left = np.ones(len(cells), bool)

    def holds(rule) -> np.ndarray:
        out = left.copy()
        for k, op, at in rule:
            out &= (place[:, k] > at) == (op == ">")
        return out

    def precision(rule, part: np.ndarray) -> float:
        some = holds(rule) & part
        return (bad[some].sum() + 1) / (bad[some].sum() + good[some].sum() + 2)

    out = []
    barred: set[tuple[int, str, int]] = set()  # first conditions that led to no rule since the last one
    while len(out) < max_rules:
        rule: list[tuple[int, str, int]] = []
        inside = left & ~prune
        b, g = int(bad[inside].sum()), int(good[inside].sum())
        while b and g and len(rule) < 4:
            best = (1e-9, None, 0, 0)
            for test in tests:
                if not rule and test in barred:
                    continue
                some = inside & ((place[:, test[0]] > test[2]) == (test[1] == ">"))
                tb, tg = int(bad[some].sum()), int(good[some].sum())
                if tb >= min_cover:
                    gain = tb * (math.log2(tb / (tb + tg)) - math.log2(b / (b + g)))
                    if gain > best[0] + 1e-9:
                        best = (gain, test, tb, tg)
            if best[1] is None:
                break
            rule.append(best[1])
            inside, b, g = holds(rule) & ~prune, best[2], best[3]
        # drop conditions from the end while the other half doesn't object
        while len(rule) > 1 and precision(rule[:-1], prune) >= precision(rule, prune):
            rule = rule[:-1]
        if not rule:
            break
        some = holds(rule)
        b, g = int(bad[some].sum()), int(good[some].sum())
        if b < min_cover or b / (b + g) < min_precision or precision(rule, prune) < min_precision - 0.1:
            barred.add(rule[0])
            continue
        out.append([(names[k], op, float(edges[names[k]][at])) for k, op, at in rule])
        left &= ~some
        barred.clear()
    return out


def expression(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The number of the first rule that holds, from 1; 0: none, so the text is kept."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for feature, op, at in rule:
            value = F.expr(FEATURES[feature])
            cond = cond & (value > at if op == ">" else value <= at)
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(stats: DataFrame, rules: list[list[tuple[str, str, float]]]) -> DataFrame:
    """The statistics with base_failed, rule (0: none) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": expression(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
