"""Document fingerprints by consistent weighted sampling.

A text is the bag of its words (ASCII white space apart, A-Z lower-cased), a word's weight its count.
For each of the samples and each term, r and c are Gamma(2, 1) and beta uniform, all drawn from a hash of term
and sample; with t = floor(ln w / r + beta), the term with the least ln c - r (t - beta + 1) is taken,
and (term, t) is the sample. Two bags agree in a sample with the probability of their generalised
Jaccard similarity. A fingerprint holds 16 bits of each sample, as hex; likeness is the share of equal ones.

Defined results. Null text: as empty. A text without words has the empty fingerprint, like any other
such (1) and unlike all else (0). Null doc_ids come first in the order, rows of one id in the order of their
texts; each row gets its result. Empty table: no rows. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .ordered import with_next
from .shared import mixed

STEP = np.uint64(0x9E3779B97F4A7C15)
UNIT = np.float32(2.0**-21)
PART = 16


def drawn(terms: np.ndarray, samples: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta for each term hash and sample."""
    key = mixed(terms[:, None] + STEP * (np.array(samples, np.uint64) + np.uint64(1))[None, :])
    more = mixed(key ^ STEP)
    u = lambda x, k: ((x >> np.uint64(21 * k)) & np.uint64(0x1FFFFF)).astype(np.float32) * UNIT + UNIT / 2
    r = -np.log(u(key, 0) * u(key, 1))
    log_c = np.log(-np.log(u(more, 0) * u(more, 1)))
    return r, log_c, u(key, 2)


def sampled(bags: list[Counter], samples: int) -> np.ndarray:
    """16 bits of each sample of each bag; bags must not be empty."""
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(w, len(number)) for bag in bags for w in bag], np.int64)
    weight = np.array([n for bag in bags for n in bag.values()], np.float32)
    starts = np.concatenate([[0], np.cumsum([len(bag) for bag in bags])])
    terms = np.array([xxhash.xxh64_intdigest(w, 9) for w in number], np.uint64)
    heavy = np.flatnonzero(weight > 1)
    log_w = np.log(weight[heavy])[:, None]
    place = np.full(len(weight), -1)
    place[heavy] = np.arange(len(heavy))
    out = np.zeros((len(bags), samples), np.uint16)
    for lo in range(0, samples, PART):  # few samples at a time stay in the cache
        some = range(lo, min(lo + PART, samples))
        r, log_c, beta = drawn(terms, some)
        value = (log_c - r * (1 - beta))[of]  # t is 0 for a weight of 1
        rh, bh = r[of[heavy]], beta[of[heavy]]
        level = np.floor(log_w / rh + bh)
        value[heavy] = log_c[of[heavy]] - rh * (level - bh + 1)
        least = np.minimum.reduceat(value, starts[:-1], axis=0)
        at, sample = np.nonzero(value == np.repeat(least, np.diff(starts), axis=0))
        t = np.zeros(len(at), np.int64)
        raised = place[at] >= 0
        t[raised] = level[place[at[raised]], sample[raised]].astype(np.int64)
        row = np.searchsorted(starts, at, "right") - 1
        # of equal values the first term stands
        out[row[::-1], lo + sample[::-1]] = (mixed(terms[of[at]] + STEP * t.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)[::-1]
    return out


def signatures(texts: list[bytes], samples: int, block: int = 20_000) -> list[bytes]:
    """The fingerprint of each text, big-endian; empty for a text without words."""
    bags = [Counter(t.lower().split()) for t in texts]
    out, part, size = [b""] * len(texts), [], 0
    for k, bag in enumerate(bags):
        if bag:
            part.append(k)
            size += len(bag)
        if part and (size >= block or k == len(bags) - 1):
            for i, sig in zip(part, sampled([bags[i] for i in part], samples).astype(">u2")):
                out[i] = sig.tobytes()
            part, size = [], 0
    return out


def likeness(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean())


def edited(text: str, behind: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + behind[:n]


def fingerprinted(docs: DataFrame, samples: int = 64) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document."""

    def run(rows, behind):
        texts = [t for _, t in rows] + [behind[1]]
        plain = [t.decode() for t in texts]
        changed = [edited(a, b).encode() for a, b in zip(plain, plain[1:])]
        # a text beside its edit: they share most terms, whose draws then serve both
        sigs = signatures([t for pair in zip(texts, changed) for t in pair] + texts[-1:], samples)
        own, new = sigs[::2], sigs[1::2]
        columns = [
            pa.array([k for k, _ in rows], pa.int64()),
            pa.array([len(t) for t in plain[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
            pa.array([s.hex() for s in own[:-1]], pa.string()),
            pa.array([s.hex() for s in new], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
