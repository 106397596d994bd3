"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The vocabulary file gives the pieces; nothing is trained. A piece's probability falls with its rank, as
1 / (rank + offset) to the power `alpha`, which turns a merge list into a unigram lattice. A segmentation is drawn
with probability proportional to the product over its pieces.

No piece reaches over the edge between a character and a following space, so a text's lattice falls apart into
chunks (spaces, then other characters). Distinct chunks of a batch, told apart by their bytes, are matched and filtered once,
all of them side by side: position by position, the log-sum over incoming pieces. Then every
occurrence walks back from its end, all side by side again: each step draws an incoming piece by the
numbers of a generator that is a function of (seed, row key, chunk, step) alone. So a row's pieces do not
depend on batches, tasks or order.

As in the vocabulary's own encoder, a space goes in front of a text, spaces stand as U+2581 and
characters without a piece fall back to bytes. A literal U+2581 goes to bytes too, so decoding gives back every text exactly.

Defined results. Null text: null ids, 0 pieces. Empty text: no pieces. Null key: the generator's key 0. Repeated
rows: the same pieces each. Very long texts: whole, alone in their block. Empty table: no rows. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_rows, frugal, mixed, row_blocks

#: The folder of public vocabularies is a parameter of the environment.
MODEL = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")

G1, G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
SLOTS = 1 << 19


@dataclass
class Vocabulary:
    """Trie transitions in an open-addressed table, and what each id stands for."""

    keys: np.ndarray  # node << 8 | byte, or -1
    nodes: np.ndarray  # the node that a transition leads to
    probes: int
    piece: np.ndarray  # piece that ends at a node, or -1
    score: np.ndarray  # log probability of each id
    starts: np.ndarray  # bytes of each id: where they start in `data`, and their number
    sizes: np.ndarray
    data: np.ndarray
    byte_id: np.ndarray  # id of each byte
    deepest: int


def slot_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def vocabulary(path: str = MODEL, alpha: float = 1.0, offset: float = 10.0) -> Vocabulary:
    """Read a vocabulary on the driver; executors get the tables."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    texts: list[bytes] = [b""] * size
    byte_id, plain = np.full(256, -1, np.int64), []
    for i in range(size):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(name[3:5], 16)] = i
            texts[i] = bytes([int(name[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            texts[i] = name.replace("\u2581", " ").encode()
            plain.append(i)
    if (byte_id < 0).any():
        raise ValueError("a vocabulary with a piece for every byte is needed")
    score = np.zeros(size)
    score[plain] = -np.log(np.arange(len(plain)) + offset)
    score[byte_id] = -np.log(len(plain) + offset)
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for i in plain:
        node = 0
        for b in texts[i]:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        ends[node] = i
    pairs = np.array([(n << 8 | b, to) for n, x in enumerate(children) for b, to in x.items()], np.int64)
    if 4 * len(pairs) > SLOTS:
        raise ValueError("the vocabulary is too large for the table")
    keys, nodes, probes = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32), 0
    todo, at = np.arange(len(pairs)), slot_of(pairs[:, 0])
    while len(todo):
        free = keys[at] < 0
        keys[at[free]] = pairs[todo[free], 0]  # of several, one stays
        won = keys[at] == pairs[todo, 0]
        nodes[at[won]] = pairs[todo[won], 1]
        todo, at, probes = todo[~won], (at[~won] + 1) % SLOTS, probes + 1
    piece = np.full(len(children), -1, np.int32)
    piece[list(ends)] = list(ends.values())
    sizes = np.array([len(t) for t in texts], np.int64)
    return Vocabulary(keys, nodes, probes, piece, score * alpha, np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(texts), np.uint8), byte_id, int(sizes.max()))


def step_down(voc: Vocabulary, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The node behind each transition, or -1."""
    key = node.astype(np.int64) << 8 | byte
    at = slot_of(key)
    out = np.full(len(key), -1, np.int64)
    open_ = np.arange(len(key))
    for _ in range(voc.probes):
        there = voc.keys[at]
        hit = there == key[open_]
        out[open_[hit]] = voc.nodes[at[hit]]
        more = ~hit & (there >= 0)
        open_, at = open_[more], (at[more] + 1) % SLOTS
        if not len(open_):
            break
    return out


def edges_of(voc: Vocabulary, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every piece in the chunks; left: bytes from a place to its chunk's end."""
    first = (data & 0xC0) != 0x80
    start = np.flatnonzero(first)
    node, depth = np.zeros(len(start), np.int64), 0
    s, e, p = [], [], []
    single = np.zeros(len(data), bool)
    width = np.diff(np.append(start, len(data)))
    wide = np.zeros(len(data), np.int64)
    wide[start] = width
    live = start
    while len(live) and depth < voc.deepest:
        node = step_down(voc, node, data[live + depth])
        keep = node >= 0
        live, node = live[keep], node[keep]
        depth += 1
        found = voc.piece[node]
        some = found >= 0
        s.append(live[some])
        e.append(live[some] + depth)
        p.append(found[some].astype(np.int64))
        single[live[some][wide[live[some]] == depth]] = True
        keep = left[live] > depth
        live, node = live[keep], node[keep]
    # characters without a piece: byte by byte
    bare = start[~single[start]]
    rest = np.repeat(bare, wide[bare])
    if len(rest):
        inside = np.arange(len(rest)) - np.repeat(np.cumsum(wide[bare]) - wide[bare], wide[bare])
        s.append(rest + inside)
        e.append(rest + inside + 1)
        p.append(voc.byte_id[data[rest + inside]])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (s, e, p))


class Lattice:
    """Distinct chunks, filtered forward. Node k of chunk c is its place k: base[c] + k."""

    def __init__(self, voc: Vocabulary, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        n = len(starts)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = data[np.repeat(starts, sizes) + inside]
        left = np.repeat(sizes, sizes) - inside
        s, e, piece = edges_of(voc, text, left)
        chunk = np.repeat(np.arange(n), sizes)
        # nodes: a chunk of m bytes has m + 1
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.final = self.base + sizes
        source, target = s + chunk[s], e + chunk[s]
        offset = target - self.base[chunk[s]]
        order = np.lexsort((target, offset))
        source, target, piece, offset = source[order], target[order], piece[order], offset[order]
        alpha = np.full(int((sizes + 1).sum()), -np.inf)
        alpha[self.base] = 0.0
        weight = voc.score[piece]
        bounds = np.searchsorted(offset, np.arange(1, (int(offset[-1]) if len(offset) else 0) + 2))
        chance = np.zeros(len(piece))
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            x = alpha[source[a:b]] + weight[a:b]
            new = np.flatnonzero(np.concatenate([[True], target[a + 1 : b] != target[a : b - 1]]))
            top = np.maximum.reduceat(x, new)
            reps = np.diff(np.append(new, b - a))
            ex = np.exp(x - np.repeat(np.where(np.isfinite(top), top, 0), reps))
            total = np.add.reduceat(ex, new)
            alpha[target[a + new]] = np.where(total > 0, top + np.log(np.maximum(total, 1e-300)), -np.inf)
            chance[a:b] = ex / np.repeat(np.maximum(total, 1e-300), reps)
        self.source, self.piece, self.log_total = source, piece, alpha[self.final]
        # incoming pieces of a node lie together; `upto` runs from 0 to 1 within a node
        change = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
        reps = np.diff(np.append(change, len(target)))
        run = np.cumsum(chance)
        self.upto = run - np.repeat(run[change] - chance[change], reps) if len(target) else run
        self.first, self.last = np.zeros(len(alpha), np.int64), np.zeros(len(alpha), np.int64)
        self.first[target[change]] = change
        self.last[target[change]] = change + reps - 1

    def sample(self, chunk: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each occurrence of a chunk, one after the other, and their number."""
        node, base = self.final[chunk], self.base[chunk]
        live = np.arange(len(chunk))
        number = np.zeros(len(chunk), np.int64)
        steps, k = [], 0
        while len(live):
            u = (mixed(key[live] + np.uint64(int(G2) * (k + 1) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = self.first[node]
            last = self.last[node]
            todo = np.flatnonzero((at < last) & (self.upto[at] <= u))
            while len(todo):
                at[todo] += 1
                todo = todo[(at[todo] < last[todo]) & (self.upto[at[todo]] <= u[todo])]
            steps.append((live, self.piece[at]))
            number[live] += 1
            node = self.source[at]
            more = node > base[live]
            live, node, k = live[more], node[more], k + 1
        out = np.zeros(int(number.sum()), np.int64)
        end = np.cumsum(number)
        for k, (rows, pieces) in enumerate(steps):
            out[end[rows] - 1 - k] = pieces
        return out, number


def chunk_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of each chunk's bytes and length, from running sums of a polynomial over random byte values."""
    rng = np.random.default_rng(77)
    value = rng.integers(1, 2**63, 256, dtype=np.uint64)
    powers = np.full(len(data) + 1, int(G1), np.uint64)
    back = np.full(len(data) + 1, pow(int(G1), -1, 1 << 64), np.uint64)
    powers[0] = back[0] = 1
    powers, back = np.cumprod(powers), np.cumprod(back)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * powers[:-1], out=sums[1:])
    return mixed((sums[starts + sizes] - sums[starts]) * back[starts] + sizes.astype(np.uint64))


def classes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pick, which): one chunk of each distinct string, and the number of each chunk's string; the chunks tile the text.

    Hashes propose the classes, the bytes decide: chunks that differ from the one that stands for their hash get classes by their bytes.
    """
    _, pick, which = np.unique(chunk_hashes(text, starts, lengths), return_index=True, return_inverse=True)
    same = lengths == lengths[pick[which]]
    there = np.repeat(starts[pick[which]] - starts, lengths) + np.arange(len(text))
    same &= ~np.logical_or.reduceat(text != text[np.minimum(there, len(text) - 1)], starts)
    more: dict[bytes, int] = {}
    added = []
    for i in np.flatnonzero(~same).tolist():
        string = text[starts[i] : starts[i] + lengths[i]].tobytes()
        if string not in more:
            more[string] = len(pick) + len(added)
            added.append(i)
        which[i] = more[string]
    return np.concatenate([pick, np.array(added, np.int64)]), which


def encode(voc: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one row after the other, and the number of each row."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    some = np.flatnonzero(sizes > 0)
    text = np.full(len(data) + len(some), 32, np.uint8)  # a space in front of each row that has a text
    text[np.arange(len(data)) + np.repeat(np.arange(1, len(some) + 1), sizes[some])] = data
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    row_start = offsets[:-1][some] + np.arange(len(some))
    space = text == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[row_start] = True
    starts = np.flatnonzero(begin)
    lengths = np.diff(np.append(starts, len(text)))
    pick, which = classes(text, starts, lengths)
    lattice = Lattice(voc, text, starts[pick], lengths[pick])
    row = np.searchsorted(row_start, starts, "right") - 1
    nth = np.arange(len(starts)) - np.searchsorted(starts, row_start)[row]
    key = mixed(mixed(keys[some][row].astype(np.uint64) + np.uint64(seed * int(G2) & (1 << 64) - 1)) + G1 * (nth.astype(np.uint64) + np.uint64(1)))
    ids, number = lattice.sample(which, key)
    count = np.zeros(n, np.int64)
    count[some] = np.bincount(row, weights=number, minlength=len(some)).astype(np.int64)
    return ids, count


def decode(voc: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offsets of the rows in them."""
    sizes = voc.sizes[ids]
    data = voc.data[np.repeat(voc.starts[ids], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    drop = ends[:-1][counts > 0]  # the space in front
    keep = np.ones(len(data), bool)
    keep[drop] = False
    return data[keep], ends - np.concatenate([[0], np.cumsum(counts > 0)])


def segmented(docs: DataFrame, voc: Vocabulary, seed: int = 0, block: int = 1 << 18) -> DataFrame:
    """(doc_id, ids, n_pieces, decoded_sha256, lossless) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(voc))  # plain arrays

    def run(batches):
        voc = Vocabulary(**shared.value)
        for batch in batches:
            data, offsets = byte_rows(batch.column(1))
            none = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in row_blocks(offsets, block):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, count = encode(voc, part, at, keys[a:b], seed)
                back, ends = decode(voc, ids, count)
                same = [np.array_equal(part[at[k] : at[k + 1]], back[ends[k] : ends[k + 1]]) for k in range(b - a)]
                sha = [hashlib.sha256(back[ends[k] : ends[k + 1]].tobytes()).hexdigest() for k in range(b - a)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(none[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(count), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "decoded_sha256", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, ids array<int>, n_pieces long, decoded_sha256 string, lossless boolean")
