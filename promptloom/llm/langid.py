"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte n-grams (sizes 2 to 4) inside and round words: A-Z is lower-cased, ASCII that is no letter
counts as one space, and grams with an inner space are left out. Each gram picks one of `buckets`
embedding rows by hash; their mean goes through a linear softmax. Both layers are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows. A temperature fitted on
sampled rows kept apart calibrates the score, and rows under the threshold found there are rejected.

Since both layers are linear, prediction folds them into one table (bucket x language), so that a
text costs one gather and one sum a gram, over the whole text.

Defined results. Null text, or one without a letter: `und`, score 0, rejected. No labelled row at all:
every row is `und`. Every label with a text is learned, however rare. Repeated rows: each gets its result. Ties between
languages: the first by name. Very long texts: whole, some hundred kB at a time. Empty table: no rows. The columns id,
text and lang are all that is read; others are left out, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_rows, frugal, mixed, row_blocks

SIZES = (2, 3, 4)
LETTER = r"\p{L}"

#: A-Z to a-z, other ASCII but letters to the space, all else as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)]


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each gram and the row it belongs to, grams of a row together."""
    n = len(offsets) - 1
    # a space before and behind each row
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    text = np.full(len(data) + 2 * n, 32, np.uint8)
    text[at] = FOLD[data]
    space = text == 32
    keep = ~(space[1:] & space[:-1])  # runs of spaces count as one
    keep = np.concatenate([[True], keep]) if len(text) else np.zeros(0, bool)
    ends = offsets[1:] + 2 * np.arange(1, n + 1)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.concatenate([[0], ends])))
    keep |= np.concatenate([[False], row[1:] != row[:-1]]) if len(text) else False
    text, row, space = text[keep], row[keep], space[keep]
    found, rows = [], []
    for size in SIZES:
        if len(text) < size:
            continue
        m = len(text) - size + 1
        code = np.full(m, size, np.uint64)
        for k in range(size):
            code = (code << np.uint64(8)) | text[k : m + k]
        good = row[:m] == row[size - 1 :]
        for k in range(1, size - 1):
            good &= ~space[k : m + k]
        code, of = code[good], row[:m][good]
        found.append((mixed(code) % np.uint64(buckets)).astype(np.int32))
        rows.append(of)
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def averaged(data: np.ndarray, offsets: np.ndarray, folded: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits of each row."""
    n = len(offsets) - 1
    out = np.zeros((n, folded.shape[1]))
    count = np.zeros(n)
    for a, b in row_blocks(offsets, 1 << 18):
        bucket, row = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], len(folded))
        count[a:b] = np.bincount(row, minlength=b - a)
        for k in range(folded.shape[1]):
            out[a:b, k] = np.bincount(row, weights=folded[bucket, k], minlength=b - a)
    return out / np.maximum(count, 1)[:, None] + bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def segments(texts: list[bytes], labels: np.ndarray, rng, pieces: int) -> tuple[list[bytes], np.ndarray]:
    """Each whole text and `pieces` random stretches of its words, so that short texts are learned too."""
    out, of = [], []
    for text, label in zip(texts, labels):
        words = text.split()
        out.append(text)
        of.append(label)
        for _ in range(pieces):
            size = int(2 ** rng.uniform(1, 8))
            at = rng.integers(0, max(1, len(words) - size + 1))
            out.append(b" ".join(words[at : at + size]))
            of.append(label)
    return out, np.array(of, np.int64)


def features(texts: list[bytes], buckets: int):
    """Where the grams of each text start, and bucket and share of each distinct one; worked out some hundred kB at a time."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes, found, shares = np.zeros(len(texts), np.int64), [], []
    for a, b in row_blocks(offsets, 1 << 18):
        bucket, row = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
        key, n = np.unique(row.astype(np.int64) * buckets + bucket, return_counts=True)
        row = key // buckets
        sizes[a:b] = np.bincount(row, minlength=b - a)
        found.append((key % buckets).astype(np.int32))
        shares.append((n / np.maximum(np.bincount(row, weights=n, minlength=b - a), 1)[row]).astype(np.float32))
    at = np.concatenate([[0], np.cumsum(sizes)])
    return at, np.concatenate(found) if found else np.zeros(0, np.int32), np.concatenate(shares) if shares else np.zeros(0, np.float32)


def train(texts: list[bytes], langs: list[str], buckets: int = 1 << 16, dim: int = 16, epochs: int = 8, rate: float = 2.0, seed: int = 1, accept: float = 0.999) -> dict:
    """The folded model: table, bias, languages, temperature and threshold."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    labels = np.array([names.index(x) for x in langs], np.int64)
    order = rng.permutation(len(texts))
    apart = order[: max(1, len(order) // 5)] if len(order) >= 10 else order
    fit = order[len(order) // 5 :] if len(order) >= 10 else order
    seg, of = segments([texts[i] for i in fit], labels[fit], rng, 3)
    at, bucket, weight = features(seg, buckets)
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, step = epochs * max(1, len(seg) // 32), 0
    for _ in range(epochs):
        perm = rng.permutation(len(seg))
        for k in range(0, len(perm), 32):
            batch = perm[k : k + 32]
            pick = np.concatenate([np.arange(at[i], at[i + 1]) for i in batch])
            which = np.repeat(np.arange(len(batch)), at[batch + 1] - at[batch])
            if not len(pick):
                continue
            b, w = bucket[pick], weight[pick]
            mean = np.zeros((len(batch), dim), np.float32)
            np.add.at(mean, which, emb[b] * w[:, None])
            p = softmax(mean @ out + bias)
            p[np.arange(len(batch)), of[batch]] -= 1
            lr = rate * (1 - step / steps)
            back = p @ out.T
            out -= lr * (mean.T @ p) / len(batch) * 4
            bias -= lr * p.mean(axis=0) * 0.1
            np.add.at(emb, b, -lr * back[which] * w[:, None])
            step += 1
    model = {"names": names, "table": (emb @ out).astype(np.float32), "bias": bias.astype(np.float64), "temperature": 1.0, "threshold": 0.0}
    seg, of = segments([texts[i] for i in apart], labels[apart], rng, 3)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in seg])]).astype(np.int64)
    logits = averaged(np.frombuffer(b"".join(seg), np.uint8), offsets, model["table"], model["bias"])
    loss = [(-np.log(softmax(logits / t)[np.arange(len(of)), of] + 1e-12).mean(), t) for t in np.geomspace(0.05, 10, 60)]
    model["temperature"] = float(min(loss)[1])
    p = softmax(logits / model["temperature"])
    right = p.max(axis=1)[p.argmax(axis=1) == of]
    # the score that all but 1 - accept of the right ones reach, and no more than a clear majority
    model["threshold"] = float(min(np.quantile(right, 1 - accept), 0.5)) if len(right) else 0.0
    return model


def sampled(docs: DataFrame, per_lang: int, seed: int = 3) -> tuple[list[bytes], list[str]]:
    """About `per_lang` labelled rows a language at most, picked by a hash of the id: the documented bound of the training set."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    share = {r["lang"]: per_lang / r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}

    @F.pandas_udf("double")
    def share_of(lang: pd.Series) -> pd.Series:
        return lang.map(share)

    picked = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < share_of("lang") * F.lit(float(1 << 20))
    rows = known.where(picked).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    used: dict[str, int] = {}
    texts, langs = [], []
    for text, lang in zip(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("lang").to_pylist()):
        used[lang] = used.get(lang, 0) + 1
        if used[lang] <= 2 * per_lang:
            texts.append(text)
            langs.append(lang)
    return texts, langs


def judged(text: pa.Array, model: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, of each row of a text column."""
    plain = re.compile("[A-Za-z]")
    some = np.array([x is not None and (plain.search(x) is not None or any(map(str.isalpha, x))) for x in text.to_pylist()], bool)
    lang, score = np.full(len(some), "und", object), np.zeros(len(some))
    if model and len(some):
        data, offsets = byte_rows(text)
        p = softmax(averaged(data, offsets, model["table"], model["bias"]) / model["temperature"])
        best = p.argmax(axis=1)
        lang = np.where(some, np.array(model["names"], object)[best], "und")
        score = np.where(some, p[np.arange(len(best)), best], 0.0)
    return lang, np.clip(score, 0, 1), ~some | (score < (model or {"threshold": 0})["threshold"]) | (lang == "und")


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""

    def run(batches):
        for batch in batches:
            lang, score, rejected = judged(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows that the model doesn't reject, with all their columns and without a shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~judged(batch.column(at).cast(pa.string()), model)[2]))

    return docs.mapInArrow(frugal(run), docs.schema)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def trained(docs: DataFrame, per_lang: int = 400) -> dict | None:
    """A model of the rows that are not held out; null ids count as held out."""
    texts, langs = sampled(docs.where(~held_out()), per_lang)
    return train(texts, langs) if texts else None
