"""Exact removal of repeated 100-byte strings by a sparse, distributed suffix sort.

A byte goes if a string of `length` bytes over it also starts earlier (smaller id, or same document and
earlier start). Sorting a suffix for every byte would move the corpus a hundred times over. So:

1. Anchors. Of each window of `length` bytes the place of the least hashed gram of GRAM bytes is its anchor.
   Equal windows have equal anchors, so only windows whose anchor gram occurs twice can repeat; an
   anchor serves some 30 windows. Within a batch, of anchors whose surroundings (all bytes of all their windows) are equal,
   byte by byte, the earliest stays; the others repeat. What stays meets by range of the hashed gram, where grams seen
   once drop out. That is all that hashes decide; a collision only leaves more to sort.
   Grams that are common in a sample of the texts, or in the batch, need no meeting: they are left over at once.
2. Suffixes. The bytes round the anchors left over are cut from the texts: their windows are the suffixes that may
   repeat. Sampled splitters range-partition them by leading bytes, here those of the anchor's gram, which equal
   suffixes share; each bucket sorts its suffixes by multikey quicksort, eight bytes a key, and all but the
   earliest of equal ones repeat. Where a gram leads too many, its suffixes are range-partitioned one by one by (bytes, id,
   place), so even one string in a third of all rows is spread; then the first string of a bucket is
   compared with the last one of the bucket before.
3. Repeats come back to their texts by id and are cut out as maximal runs.

Defined results. Null text: as empty. Texts under `length` bytes: nothing goes. Null ids come before all others.
Rows with one id count in the order of a hash of their texts; rows equal in id and text are one document and
get the same result each. Very long texts: whole, alone in their batch. Empty table: no rows. Columns other than
doc_id and text are left out. A length under GRAM or over LONGEST: ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import NO_ID
from .shared import byte_rows, dropped, frugal, frugal_group, hash_keep, mixed, row_blocks, written

GRAM, LONGEST = 40, 30_000
#: Bytes of text that a task compares within itself, and for each range of grams; surroundings of one gram in a batch from which it counts as common;
#: anchors of one gram beyond which its suffixes are dealt one by one; anchors sorted at once; suffixes for each bucket.
BATCH, RANGE, HOT, LED, BLOCK, BUCKET = 8 << 20, 8 << 20, 256, 5_000, 2_000, 400_000
#: Bytes of text sampled for common grams; a gram counts as common with so many anchors in the sample that a meeting place would hold over COMMON in all.
SAMPLE, COMMON, SEEN = 64 << 20, 20_000, 20
#: Suffixes in a group that quicksort leaves to a plain sort.
SMALL = 48

ANCHOR = np.dtype([("key", "<u8"), ("k", "<i8"), ("th", "<i8"), ("pos", "<u4"), ("off", "<u2"), ("cnt", "<u2")])
SPANS, NEAR, FAR = 0, 1, 2
FIELDS = ["kind", "k", "th", "data", "at"]


def running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial over random byte values, and what brings the hash of [a, b) to one scale: (sums[b] - sums[a]) * back[a]."""
    value = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
    powers = np.full(len(data) + 1, 0x9E3779B97F4A7C15, np.uint64)
    back = np.full(len(data) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    powers[0] = back[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * np.cumprod(powers, out=powers)[:-1], out=sums[1:])
    return sums, np.cumprod(back, out=back)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        if len(x) <= step:
            return x[:0]
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, place, windows before it, windows, gram hash, surroundings hash) of the anchors of all rows."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    sums, back = running(data)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1])
    least = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    least &= np.uint64(0xFFFFFFFF)
    begin = np.ones(len(least) + 1, bool)
    begin[1:-1] = least[1:] != least[:-1]
    begin[np.minimum(offsets, len(least))] = True  # where rows begin
    begin[np.clip(offsets[1:] - length + 1, 0, len(least))] = True  # and where their windows end
    cut = np.flatnonzero(begin)
    first, count = cut[:-1], np.diff(cut)
    row = np.searchsorted(offsets, first, "right") - 1
    inside = first + length <= offsets[row + 1]
    row, first, count = row[inside], first[inside], count[inside]
    place = least[first].astype(np.int64)
    ends = first + count - 1 + length
    ctx = mixed((sums[ends] - sums[first]) * back[first] + ((place - first) << 32 | (ends - first)).astype(np.uint64))
    return row, place, place - first, count, mixed(grams[place]), ctx  # anew, since anchors have small hashes


def packed(rows: np.ndarray) -> bytes:
    """Rows of a structured array, byte plane by byte plane."""
    planes = rows.view(np.uint8).reshape(len(rows), -1).T.copy() if len(rows) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return planes.reshape(kind.itemsize, -1).T.copy().reshape(-1).view(kind) if len(planes) else np.zeros(0, kind)


def equal_to(data: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Whether the `size` bytes (one at least) from each start are those from the other start."""
    out = np.zeros(len(start), bool)
    for a in range(0, len(start), block):
        n = size[a : a + block]
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum()))
        x, y = (at + np.repeat(v[a : a + block] - begin, n) for v in (start, other))
        out[a : a + block] = ~np.logical_or.reduceat(data[x] != data[y], begin)
    return out


def repeated_here(rows: np.ndarray, ctx: np.ndarray, data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, again): rows whose surroundings another row of the batch has, earlier, byte by byte; and rows of one document that is there twice."""
    order = np.lexsort((rows["pos"], rows["th"], rows["k"], ctx))
    new = np.concatenate([[True], ctx[order[1:]] != ctx[order[:-1]]]) if len(order) else np.zeros(0, bool)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    some = head != order
    member, head = order[some], head[some]
    same = (rows["off"][member] == rows["off"][head]) & (rows["cnt"][member] == rows["cnt"][head])
    member, head = member[same], head[same]
    same = equal_to(data, start[member], rows["cnt"][member].astype(np.int64) - 1 + length, start[head])
    member, head = member[same], head[same]
    twin = (rows["k"][member] == rows["k"][head]) & (rows["th"][member] == rows["th"][head]) & (rows["pos"][member] == rows["pos"][head])
    return member[~twin], member[twin]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, as sorted ones that neither overlap nor touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def by_document(rows: np.ndarray, length: int) -> pa.RecordBatch:
    """(kind, k, th, data, at): for each document its repeated intervals (start, end)."""
    start = rows["pos"].astype(np.int64) - rows["off"]
    order = np.lexsort((start, rows["th"], rows["k"]))
    rows, start = rows[order], start[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["k"][1:] != rows["k"][:-1]) | (rows["th"][1:] != rows["th"][:-1])
    doc = np.cumsum(new) - 1
    end = np.maximum.accumulate(start + rows["cnt"] - 1 + length + (doc << 33)) - (doc << 33)  # the greatest so far in the document
    cut = new.copy()
    cut[1:] |= start[1:] > end[:-1]
    last = np.append(cut[1:], True)[: len(rows)]
    items, of = np.stack([start[cut], end[last]], axis=1), doc[cut]
    sizes = np.bincount(of, minlength=int(new.sum())) * 8
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(items.astype("<u4").tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), SPANS, np.int64)), pa.array(rows["k"][new]), pa.array(rows["th"][new]), data, pa.nulls(len(sizes), pa.int64())], FIELDS)


def left_over(rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """(kind, k, th, data, at): for each anchor its place, off and cnt in one number, and whether it is far in the last bit."""
    at = rows["pos"].astype(np.int64) << 31 | rows["off"].astype(np.int64) << 16 | rows["cnt"].astype(np.int64) << 1 | (kind == FAR)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int64)), pa.array(rows["k"]), pa.array(rows["th"]), pa.nulls(len(rows), pa.binary()), pa.array(at)], FIELDS)


def keyed(docs: DataFrame) -> DataFrame:
    """(k, th, text): the order of documents; th tells rows of one id apart and is 0 where no id is repeated."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    repeated = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return rows.select("k", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("th"), "text")


def placed(ks: np.ndarray, ths: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of rows, the hashes of their surroundings, and where these start in the data."""
    parts, ctxs, starts = [], [], []
    for a, b in row_blocks(offsets, 1 << 20):
        row, place, off, cnt, key, ctx = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
        part = np.zeros(len(row), ANCHOR)
        part["key"], part["k"], part["th"] = key, ks[a:b][row], ths[a:b][row]
        part["pos"], part["off"], part["cnt"] = place - (offsets[a:b][row] - offsets[a]), off, cnt
        parts.append(part)
        ctxs.append(ctx)
        starts.append(place - off + offsets[a])
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(parts, ANCHOR), cat(ctxs, np.uint64), cat(starts, np.int64)


def common_grams(rows: DataFrame, size: int, length: int) -> np.ndarray:
    """Sorted hashes of grams that a sample of the texts holds so often that they should not meet in one place. The sample decides nothing but that."""
    share = min(1.0, SAMPLE / max(size, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_rows(batch.column(0))
            for a, b in row_blocks(offsets, 1 << 20):
                found, n = np.unique(anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])

    least = max(SEEN, int(COMMON * share))
    found = rows.where(hash_keep(F.col("k"), share, 29)).select("text").mapInArrow(frugal(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("key").toArrow().column(0).to_numpy().view(np.uint64))


def met(rows: DataFrame, n_ranges: int, common: np.ndarray, length: int) -> DataFrame:
    """(kind, k, th, data, at): repeats within a batch, and anchors left for the suffix sort."""
    fields = ["bucket", *FIELDS]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_rows(batch.column(2))
            for a, b in row_blocks(offsets, BATCH):
                yield from anchored(batch.column(0).slice(a, b - a).to_numpy(), batch.column(1).slice(a, b - a).to_numpy(), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def anchored(ks: np.ndarray, ths: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        every, ctx, start = placed(ks, ths, data, offsets, length)
        again, twins = repeated_here(every, ctx, data, start, length)
        keep = np.ones(len(every), bool)
        keep[again] = keep[twins] = False
        rest = every[keep]
        rest = rest[np.argsort(rest["key"], kind="stable")]
        if len(rest):
            new = np.concatenate([[True], rest["key"][1:] != rest["key"][:-1]])
            many = (np.diff(np.append(np.flatnonzero(new), len(rest))) > HOT)[np.cumsum(new) - 1]
            mark = rest[new & many]  # says that the gram has other surroundings elsewhere
            mark["cnt"] = 0
            hot = many | np.isin(rest["key"], common)
        else:
            mark = hot = np.zeros(0, ANCHOR)
            hot = np.zeros(0, bool)
        for done in (by_document(every[again], length), left_over(rest[hot], FAR)):
            yield pa.RecordBatch.from_arrays([pa.array(n_ranges + done.column("k").to_numpy() % n_ranges), *done.columns], fields)
        rest = np.concatenate([rest[~hot], mark])
        if not len(rest):
            return
        home = ((rest["key"] >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.unique(home))
        blobs = [packed(rest[order[x:y]]) for x, y in zip(cuts, np.append(cuts[1:], len(order)))]
        none = pa.array(np.zeros(len(cuts), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(home[order[cuts]]), pa.array(np.full(len(cuts), -1)), none, none, pa.array(blobs, pa.binary()), none], fields)

    def meet(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        passed = table.filter(pa.array([k >= 0 for k in kinds])).select(FIELDS)
        blobs = [x for x, k in zip(table.column("data").to_pylist(), kinds) if k < 0]
        if not blobs:
            return passed
        every = np.concatenate([unpacked(x, ANCHOR) for x in blobs])
        every = every[np.argsort(every["key"], kind="stable")]
        new = np.concatenate([[True], every["key"][1:] != every["key"][:-1]])
        number = np.diff(np.append(np.flatnonzero(new), len(every)))
        marked = np.logical_or.reduceat(every["cnt"] == 0, np.flatnonzero(new))
        of = np.cumsum(new) - 1
        number, marked, real = number[of], marked[of], every["cnt"] > 0
        far = marked | (number > LED)
        made = [left_over(every[real & far], FAR), left_over(every[real & ~far & (number > 1)], NEAR)]
        return pa.concat_tables([passed, pa.Table.from_batches(made)])

    blobs = rows.mapInArrow(frugal(find), "bucket long, kind long, k long, th long, data binary, at long")
    return written(blobs.groupBy("bucket").applyInArrow(frugal_group(meet), "kind long, k long, th long, data binary, at long"), "suffix-anchors")


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): row numbers sorted by all words of a row, equal rows in their order, and where new rows begin.

    Multikey quicksort, all groups of a round side by side: each splits round the median of three of its
    words at its own depth into less, equal and greater; equal ones go one word deeper. Groups of SMALL rows or
    fewer are sorted plainly in the end, word by word.
    """
    n, wide = words.shape
    order, head = np.arange(n), np.ones(n, bool)
    if n < 2:
        return order, head
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    small: list[tuple[np.ndarray, np.ndarray]] = []
    while len(start):
        big = size > SMALL
        small.append((start[~big], size[~big]))
        start, size, depth = start[big], size[big], depth[big]
        if not len(start):
            break
        group = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(group)) + np.repeat(start - (np.cumsum(size) - size), size)
        rows = order[at]
        word = words[rows, depth[group]]
        three = np.stack([words[order[start + x], depth] for x in (0 * size, size // 2, size - 1)])
        pivot = np.sort(three, axis=0)[1][group]
        part = (3 * group + (word >= pivot) + (word > pivot)).astype(np.uint16 if 3 * len(start) < 1 << 16 else np.int64)
        order[at] = rows[np.argsort(part, kind="stable")]
        number = np.bincount(part, minlength=3 * len(start)).reshape(-1, 3)
        begin = start[:, None] + np.cumsum(number, axis=1) - number
        deeper = depth[:, None] + np.array([0, 1, 0])
        some = (number > 1) & (deeper < wide)  # at the last word equal rows are done
        start, size, depth = begin[some], number[some], deeper[some]
    start, size = (np.concatenate([x[i] for x in small]) for i in (0, 1))
    group = np.repeat(np.arange(len(start)), size)
    at = np.arange(len(group)) + np.repeat(start - (np.cumsum(size) - size), size)
    by = np.argsort(at)
    at, group = at[by], np.cumsum(np.concatenate([[1], np.diff(group[by]) != 0])) if len(at) else at
    for k in range(wide):
        if not len(at):
            break
        rows = order[at]
        again = np.lexsort((rows, words[rows, k], group))
        rows = rows[again]
        order[at] = rows
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (words[rows[1:], k] != words[rows[:-1], k])
        tied = ~new
        tied[:-1] |= ~new[1:]
        at, group = at[tied], np.cumsum(new)[tied]
    head[1:] = False
    for k in range(wide):
        word = words[order, k]
        head[1:] |= word[1:] != word[:-1]
    return order, head


def as_words(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The strings of `length` bytes from each start, as big-endian words filled up with zeros."""
    wide = -(-length // 8) * 8
    out = np.zeros((len(starts), wide), np.uint8)
    if len(starts):
        out[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    return out.view(">u8").astype(np.uint64)


def later_equal(order: np.ndarray, head: np.ndarray, k: np.ndarray, th: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of rows in the order of (k, th, p): whether an equal string starts earlier."""
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = (k[order] != k[first]) | (th[order] != th[first]) | (p[order] != p[first])
    return out


def span_rows(k: np.ndarray, th: np.ndarray, p: np.ndarray, length: int, number=1) -> pa.RecordBatch:
    """(k, th, data): the intervals of repeated windows, by document; `number` of them from each place."""
    rows = np.zeros(len(k), ANCHOR)
    rows["k"], rows["th"], rows["pos"], rows["cnt"] = k, th, p, number
    return by_document(rows, length).select(["k", "th", "data"])


def cut_out(rows: DataFrame, left: DataFrame, length: int) -> DataFrame:
    """(far, lead, k, th, p, seg): for each anchor left over its gram, and from the first of its windows to the end of the last."""
    fields = ["far", "lead", "k", "th", "p", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], fields)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                k, th, text, at = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_buffer().to_pybytes(), np.sort(batch.column(3)[i].values.to_numpy())
                for pos, off, cnt, far in zip(*((at >> shift & mask).tolist() for shift, mask in ((31, (1 << 32) - 1), (16, 0x7FFF), (1, 0x7FFF), (0, 1)))):
                    out.append((far == 1, text[pos : pos + GRAM], k, th, pos - off, text[pos - off : pos - off + cnt - 1 + length]))
                if len(out) >= 5_000:
                    yield as_batch(out)
                    out = []
            if out:
                yield as_batch(out)

    asked = left.groupBy("k", "th").agg(F.collect_list("at").alias("at"))
    return rows.join(asked, ["k", "th"]).select("k", "th", "text", "at").mapInArrow(frugal(run), "far boolean, lead binary, k long, th long, p long, seg binary")


def windows(segs: list[bytes], k: np.ndarray, th: np.ndarray, p: np.ndarray, length: int):
    """Of each segment every window: the bytes of all segments, starts in them, and k, th, p of each window."""
    sizes = np.array([len(x) for x in segs], np.int64)
    number = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(segs)), number)
    step = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    return np.frombuffer(b"".join(segs), np.uint8), (np.cumsum(sizes) - sizes)[row] + step, k[row], th[row], p[row] + step


def repeated_near(segs: DataFrame, n: int, length: int) -> DataFrame:
    """Repeats among the suffixes that each gram leads, where a bucket holds all of a gram's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> list[pa.RecordBatch]:
            segs, of = table.column("seg").to_pylist(), [table.column(x).to_numpy() for x in ("k", "th", "p")]
            # equal bytes round an anchor: the windows of the first stand for all
            first: dict[bytes, int] = {}
            head = np.array([first.setdefault(x, i) for i, x in enumerate(segs)])
            own = np.flatnonzero(head == np.arange(len(segs)))
            data, starts, k, th, p = windows([segs[i] for i in own], *(x[own] for x in of), length)
            again = later_equal(*multikey(as_words(data, starts, length)), k, th, p)
            spans = [span_rows(k[again], th[again], p[again], length)]
            rest = np.flatnonzero(np.logical_or.reduce([x != x[head] for x in of]))
            spans.append(span_rows(*(x[rest] for x in of), length, np.array([len(segs[i]) - length + 1 for i in rest], np.int64)))
            return pa.Table.from_batches(spans).combine_chunks().to_batches()

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(a, BLOCK))
                table = pa.Table.from_batches(held)
                leads = table.column("lead").to_pylist()
                cut = len(leads) - 1
                while cut > 0 and leads[cut - 1] == leads[-1]:
                    cut -= 1
                if cut:
                    yield from done(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return segs.repartitionByRange(n, "lead").sortWithinPartitions("lead", "k", "th", "p").mapInArrow(frugal(run), "k long, th long, data binary")


def repeated_far(segs: DataFrame, n: int, length: int) -> DataFrame:
    """Repeats among suffixes dealt one by one, so that equal ones may lie in several buckets."""
    from pyspark import TaskContext

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                data, starts, k, th, p = windows(part.column(3).to_pylist(), *(part.column(x).to_numpy() for x in range(3)), length)
                block = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
                w = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(starts), [None, pa.py_buffer(block.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([w, pa.array(k), pa.array(th), pa.array(p)], ["w", "k", "th", "p"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("w", pa.binary()), ("k", pa.int64()), ("th", pa.int64()), ("p", pa.int64())]))
        if not table.num_rows:
            return
        k, th, p = (table.column(x).to_numpy() for x in ("k", "th", "p"))
        by = np.lexsort((p, th, k))
        k, th, p = k[by], th[by], p[by]
        raw = byte_rows(table.column("w").combine_chunks())[0]
        del table
        starts = by * length
        order, head = multikey(as_words(raw, starts, length))
        again = later_equal(order, head, k, th, p)
        spans = span_rows(k[again], th[again], p[again], length)
        run = order[: int(np.flatnonzero(np.append(head[1:], True))[0]) + 1]  # the first string's places
        run = run[~again[run]]
        string = lambda i: raw[starts[i] : starts[i] + length].tobytes()
        heads = span_rows(k[run], th[run], p[run], length)
        pid = TaskContext.get().partitionId()
        for rows, first, last in ((spans, None, None), (heads, string(order[0]), string(order[-1]))):
            m = rows.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([pid] * m, pa.int64()), pa.array([first] * m, pa.binary()), pa.array([last] * m, pa.binary()), *rows.columns], ["pid", "first", "last", "k", "th", "data"])

    single = segs.select("k", "th", "p", "seg").mapInArrow(frugal(explode), "w binary, k long, th long, p long")
    found = written(single.repartitionByRange(n, "w", "k", "th", "p").mapInArrow(frugal(sort), "pid long, first binary, last binary, k long, th long, data binary"), "suffix-far")
    edges = found.where("first is not null").groupBy("pid").agg(F.first("first").alias("first"), F.first("last").alias("last")).orderBy("pid").collect()
    joined = [b["pid"] for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]]
    return found.where(F.col("first").isNull() | F.col("pid").isin(joined)).select("k", "th", "data")


def cleaned(docs: DataFrame, length: int = 100, bytes_too: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; kept: the bytes that stay, or null."""
    if not GRAM <= length <= LONGEST:
        raise ValueError(f"a length from {GRAM} to {LONGEST} is needed")
    rows = keyed(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = met(rows, max(1, size // RANGE), common_grams(rows, size, length), length)
    segs = written(cut_out(rows, found.where(F.col("kind") != SPANS), length), "suffix-segments")
    n = {r["far"]: r["n"] for r in segs.groupBy("far").agg(F.count("*").alias("n")).collect()}
    spans = [found.where(F.col("kind") == SPANS).select("k", "th", "data")]
    if n.get(False):
        spans.append(written(repeated_near(segs.where("not far"), max(1, 8 * n[False] // BUCKET), length), "suffix-near"))
    if n.get(True):
        spans.append(repeated_far(segs.where("far"), max(1, 40 * n[True] // BUCKET), length))
    dropped(docs.sparkSession, segs.shared_path)
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    gone = every.groupBy("k", "th").agg(F.collect_list("data").alias("blobs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                k, text, blobs = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes(), batch.column(2)[i].as_py()
                kept, n_removed, n_spans = text, 0, 0
                if blobs:
                    s, e = merged(*np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in blobs]).T.astype(np.int64))
                    n_removed, n_spans = int((e - s).sum()), len(s)
                    kept = b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)]))
                out.append((None if k == NO_ID else k, len(text), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if bytes_too else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    joined = rows.join(gone, ["k", "th"], "left").select("k", "text", "blobs")
    return joined.mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
