"""Soft-membership mixing: domain posteriors, and document rates whose expected domain totals match targets.

A document's domain is `q<quality>t<toxic>` of the labels table. A softmax classifier over the presence
of frequent words (hashed) and a few figures of a text is trained in numpy on a bounded sample of labelled rows; every document gets its
posterior p and its token count n (ASCII white space apart). Rates r >= 0 then minimise the squared distance, in the metric of
the Gram matrix G = sum n p p', between the totals sum r n p and the targets, by projected gradient from r = 1:
r <- max(0, y - p . v) with v = G^-1 (totals of y - targets), for which a step of 1 is safe, and y the rates carried on by
Nesterov's momentum, which starts afresh where the gap grows. It ends when the targets are met or no rate moves any more. All
documents take part in every iteration; the driver sees a few numbers a domain, and the list of steps is the whole
state, so that any task can compute any rate anew.

Copies are floor(r + u) with u uniform from a hash of the id, so their expectation is the rate.

Defined results. Null text: no tokens, the posterior of an empty text. Null id: u is that of null. Repeated
rows: the same rate and copies each. Ties between domains: the first by name. Very long texts: whole, alone in their block. No labelled row, or no targets met by the domains: one domain, rate 1.
Empty table: no rows. Targets that no rates reach: the nearest totals. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_rows, frugal, hash_keep, mixed, row_blocks, written

BUCKETS = 1 << 18
FIGURES = 4

#: A-Z to a-z, other ASCII but letters to the space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)]
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\v\f\r")] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every word of letters, tokens of each row, figures of each row."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    folded = FOLD[data]
    inner = folded != 32
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets[:-1][sizes > 0]] = True
    begin = inner & (row_start[:-1] | np.concatenate([[True], ~inner[:-1]])) if len(data) else inner
    starts = np.flatnonzero(begin)
    stop = inner & (np.concatenate([~inner[1:], [True]]) | row_start[1:]) if len(data) else inner
    if len(data):
        stop[-1] = inner[-1]
    ends = np.flatnonzero(stop) + 1
    rng = np.random.default_rng(13)
    value = rng.integers(1, 2**63, 256, dtype=np.uint64)
    powers = np.full(len(data) + 1, 0x9E3779B97F4A7C15, np.uint64)
    back = np.full(len(data) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    powers[0] = back[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[folded] * np.cumprod(powers)[:-1], out=sums[1:])
    bucket = (mixed((sums[ends] - sums[starts]) * np.cumprod(back)[starts]) >> np.uint64(64 - 18)).astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    blank = BLANK[data]
    token = ~blank & (row_start[:-1] | np.concatenate([[True], blank[:-1]])) if len(data) else blank
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    tokens, symbols = count(token), count(SYMBOL[data])
    same = np.zeros(len(starts), bool)
    same[1:] = (bucket[1:] == bucket[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[same], minlength=n)
    t = np.maximum(tokens, 1)
    figures = np.stack([np.log1p(tokens) / 5, np.log1p(100 * symbols / t) / 3, np.log1p(100 * repeats / t) / 3, (symbols > 0).astype(float)], axis=1)
    return row, bucket, tokens, figures


def incidence(data: np.ndarray, offsets: np.ndarray, place: np.ndarray | None):
    """Distinct (row, column) of words that have a column (all buckets if place is None), tokens and figures."""
    rows, columns, tokens, figures = [], [], [], []
    width = BUCKETS if place is None else int(place.max()) + 2
    for a, b in row_blocks(offsets, 1 << 20):
        row, bucket, tok, fig = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        column = bucket if place is None else place[bucket]
        row, column = row[column >= 0], column[column >= 0]
        pair = np.unique(row * width + column)
        rows.append(pair // width + a)
        columns.append(pair % width)
        tokens.append(tok)
        figures.append(fig)
    cat = lambda x, empty: np.concatenate(x) if x else empty
    none = np.zeros(0, np.int64)
    return cat(rows, none), cat(columns, none), cat(tokens, none), cat(figures, np.zeros((0, FIGURES)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logits(model: dict, row: np.ndarray, column: np.ndarray, figures: np.ndarray) -> np.ndarray:
    out = figures @ model["figures"] + model["bias"]
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(row, weights=model["words"][column, k], minlength=len(out))
    return out


def fit(texts: list[bytes], labels: list[str], epochs: int = 150, rate: float = 0.05, decay: float = 1e-3) -> dict:
    """Softmax regression by Adam; only words in half a percent of the texts and five texts at least have weights."""
    names = sorted(set(labels))
    y = np.eye(len(names))[[names.index(x) for x in labels]]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    row, bucket, _, figures = incidence(data, offsets, None)
    df = np.bincount(bucket, minlength=BUCKETS)
    place = np.full(BUCKETS, -1, np.int64)
    chosen = np.flatnonzero(df >= max(5, len(texts) // 200))
    place[chosen] = np.arange(len(chosen))
    keep = place[bucket] >= 0
    row, column = row[keep], place[bucket[keep]]
    model = {"names": names, "place": place, "words": np.zeros((len(chosen) + 1, len(names))), "figures": np.zeros((FIGURES, len(names))), "bias": np.log(y.mean(axis=0) + 1e-9)}
    moments = {k: (0.0, 0.0) for k in ("words", "figures", "bias")}
    for step in range(1, epochs + 1):
        err = (softmax(logits(model, row, column, figures)) - y) / len(texts)
        words = np.stack([np.bincount(column, weights=err[row, k], minlength=len(chosen) + 1) for k in range(len(names))], axis=1)
        grads = {"words": words + decay * model["words"], "figures": figures.T @ err + decay * model["figures"], "bias": err.sum(axis=0)}
        for k, g in grads.items():
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            moments[k] = (m, v)
            model[k] = model[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, seed: int = 17) -> dict | None:
    """Classifier of about `max_rows` labelled rows at most, picked by a hash of the id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))).alias("domain"))
    n = known.count()
    if not n:
        return None
    picked = hash_keep(F.col("doc_id"), max_rows / n, seed)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(picked & F.col("text").isNotNull())
    rows = text.join(known.where(picked), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]).slice(0, 2 * max_rows)
    return fit(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("domain").to_pylist()) if rows.num_rows else None


def posteriors(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, n_tokens, p) of every row; p in the order of the model's domains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_rows(batch.column(1))
            row, column, tokens, figures = incidence(data, offsets, model["place"] if model else np.full(BUCKETS, -1, np.int64))
            p = softmax(logits(model, row, column, figures)) if model else np.ones((batch.num_rows, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens.astype(np.int64)), lists], ["doc_id", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, n_tokens long, p array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def rates_after(p: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates after all steps, the same carried on by the momentum, and how far the last step moved each."""
    r = y = np.ones(len(p))
    moved = np.zeros(len(p))
    for v, momentum in steps:
        new = np.maximum(0, y - p @ v)
        moved = np.abs(new - y)
        y = new + momentum * (new - r)
        r = new
    return r, y, moved


def solved(post: DataFrame, width: int, targets, rounds: int = 150, tolerance: float = 1e-6, patience: int = 20) -> tuple[list[tuple[np.ndarray, float]], np.ndarray, np.ndarray]:
    """Steps of the projected gradient, the totals that they reach, and the targets; targets: a function of the totals at rate 1.

    It ends too when `patience` rounds together bring the distance down by less than a thousandth; warns if none of it holds within the rounds.
    """

    def summed(steps: list[tuple[np.ndarray, float]], gram: bool) -> np.ndarray:
        size = width * width if gram else 2 * width + 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                n, p = batch.column(0).to_numpy(zero_copy_only=False).astype(float), matrix(batch.column(1), width)
                if gram:
                    total += ((p * n[:, None]).T @ p).ravel()
                else:
                    r, y, moved = rates_after(p, steps)
                    total += np.concatenate([(r * n) @ p, (y * n) @ p, [moved @ n, n.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "x"])

        rows = post.select("n_tokens", "p").mapInArrow(frugal(run), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(size)
        for r in rows:
            out[r["i"]] = r["x"]
        return out

    gram = summed([], True).reshape(width, width)
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    steps: list[tuple[np.ndarray, float]] = []
    state = summed(steps, False)
    goal = np.asarray(targets(state[:width]), float)
    scale = max(float(np.linalg.norm(goal)), 1.0)
    trail, pace, gap = [np.inf], 1.0, 0.0
    for _ in range(rounds):
        totals, ahead, (moved, n) = state[:width], state[width : 2 * width], state[2 * width :]
        gap = float(np.linalg.norm(totals - goal)) / scale
        distance = float((totals - goal) @ inverse @ (totals - goal))
        stuck = len(trail) > patience and min(trail[-patience:]) > 0.999 * min(trail[:-patience])
        if gap < tolerance or (steps and moved <= tolerance * n) or stuck:
            break
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        momentum = (pace - 1) / faster if distance < trail[-1] else 0.0
        pace = faster if distance < trail[-1] else 1.0
        trail.append(distance)
        steps.append((inverse @ (ahead - goal), momentum))
        state = summed(steps, False)
    else:
        warnings.warn(f"rates after {rounds} rounds: totals are {gap:.2g} of the targets away and still move", stacklevel=2)
    return steps, state[:width], goal


def copies_of(rate):
    """floor(rate + u), u by a hash of the id."""
    u = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("long")


def weighted(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, factors: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies) of every row.

    Targets: either `weights`, shares of the tokens there are for each domain (a domain without one gets none),
    or `factors` on each domain's own expected tokens (1 without one).
    """
    model = trained(docs, labels)
    names = model["names"] if model else ["all"]
    post = written(posteriors(docs, model), "mixing-posteriors")

    def targets(totals: np.ndarray) -> np.ndarray:
        if weights is not None and (share := np.array([weights.get(x, 0.0) for x in names])).sum() > 0:
            return share / share.sum() * totals.sum()
        return totals * np.array([(factors or {}).get(x, 1.0) for x in names])

    steps, _, _ = solved(post, len(names), targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = matrix(batch.column(2), len(names))
            domain = [names[k] for k in p.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(domain, pa.string()), batch.column(2), pa.array(rates_after(p, steps)[0])], ["doc_id", "n_tokens", "domain", "posterior", "rate"])

    out = post.mapInArrow(frugal(run), "doc_id long, n_tokens long, domain string, posterior array<double>, rate double")
    return out.withColumn("copies", copies_of(F.col("rate")))
