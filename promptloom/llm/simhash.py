"""SimHash fingerprints, exact near-duplicate links through sharded vantage-point trees, and exact links by similarity.

Two fingerprints link if they differ in at most `radius` of 64 bits. A vantage-point tree over all
64 bits can't prune here: distances between unrelated fingerprints crowd round 32, so that nearly
every query overlaps every ball. Hence a forest: the bits are cut into parts, and by the general
pigeonhole principle a linked pair differs in at most r_i bits of some part i, where the r_i add up
to radius - parts + 1. The more fingerprints, the fewer and wider the parts, so that a part's values don't run out. Each part
gets a vantage-point tree in its own Hamming distance, grown on a bounded sample. A fingerprint has one home leaf a tree, and
visits each leaf that its ball of radius r_i overlaps by the triangle bound |d(q, v) - d(x, v)| <= d(q, x); so every linked
pair meets in a leaf. A leaf is a shard; there a tree of its own, grown on what came, prunes further, and all 64 bits decide.

A small radius misses most pairs with a Jaccard similarity of 0.8, and no radius reaches all. By
similarity, such pairs are candidates too whose sets of shingles share one of their prefixes: sorted by
one order, two sets of n and m shingles with similarity t share one of the first n - ceil(t n) + 1 and
m - ceil(t m) + 1. The exact similarity decides on every candidate.

Defined results. Null text: as empty, fingerprint zero. Null doc_id: a fingerprint, but no part in
links; component_id null. Repeated doc_ids: each row counts. Ties: of equal fingerprints the smallest doc_id stands for all.
Very long texts: whole, one at a time. Empty table: no rows. Further columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, components, dropped, frugal, hash_keep, written

#: Fingerprints that a leaf should hold, sampled ones for each leaf of a tree, least and greatest depth of it, homes and rows of one cell at most.
LEAF, SAMPLES, SHALLOW, DEEP, HOMES, ROWS = 2048, 16, 2, 16, 4096, 16384
#: Homes that a leaf of a shard's own tree holds at most, where vantage points can split them.
INNER = 256
#: Frequent shingles that are told apart, and rows of prefixes for each bucket.
COMMON, TOKENS = 200_000, 250_000
#: Ids of asked documents that are broadcast at most (more are joined by a shuffle), and shingles of asked sets in one Arrow batch.
WANTED, HELD = 500_000, 2_000_000
#: Bits of the short parities, by which pairs are ruled out before they leave their shingle.
SHORT = 512


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, fp): lower-cased A-Z, words between ASCII white space, shingles with repeats, XXH64 with seed 42."""

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(x or b"", shingle)) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, fp long")


def parts_of(radius: int, parts: int = 4) -> list[tuple[int, int]]:
    """(bit mask, radius) of each part; the radii add up to radius - parts + 1."""
    cuts = [round(64 * k / parts) for k in range(parts + 1)]
    spare = max(0, radius - parts + 1)
    radii = [spare // parts + (k < spare % parts) if radius >= parts - 1 else (0 if k <= radius else -1) for k in range(parts)]
    return [(((1 << b) - 1) ^ ((1 << a) - 1), r) for a, b, r in zip(cuts, cuts[1:], radii) if r >= 0]


def parts_for(n: int, radius: int) -> int:
    """Parts for n fingerprints: as many as leave each part so many values that a leaf needs to hold LEAF of them only."""
    most = max(1, min(4, radius))
    return max((k for k in range(1, most + 1) if n <= LEAF << (64 // k)), default=1)


def grow(sample: np.ndarray, mask: int, depth: int, rng) -> tuple | None:
    """A tree (vantage, distance, near, far) over sampled fingerprints; None is a leaf."""
    if depth == 0 or len(sample) < 8:
        return None
    best = None
    for v in rng.choice(sample, min(8, len(sample)), replace=False):
        d = np.bitwise_count((sample ^ v) & np.uint64(mask))
        for mu in np.unique(d)[:-1]:
            share = abs(float((d <= mu).mean()) - 0.5)
            if best is None or share < best[0]:
                best = (share, int(v), int(mu), d <= mu)
    if best is None or best[0] > 0.49:
        return None
    _, v, mu, near = best
    return (v, mu, grow(sample[near], mask, depth - 1, rng), grow(sample[~near], mask, depth - 1, rng))


def routed(fps: np.ndarray, tree: tuple | None, mask: int, radius: int, leaf: int = 0, rows: np.ndarray | None = None, home: np.ndarray | None = None):
    """Yields (leaf, rows that it overlaps, whether it is their home); leaves are numbered as a binary heap."""
    if rows is None:
        rows, home = np.arange(len(fps)), np.ones(len(fps), bool)
    if not len(rows):
        return
    if tree is None:
        yield leaf, rows, home
        return
    v, mu, near, far = tree
    d = np.bitwise_count((fps[rows] ^ np.uint64(v)) & np.uint64(mask)).astype(np.int64)
    left, right = d - radius <= mu, d + radius > mu
    yield from routed(fps, near, mask, radius, 2 * leaf + 1, rows[left], home[left] & (d[left] <= mu))
    yield from routed(fps, far, mask, radius, 2 * leaf + 2, rows[right], home[right] & (d[right] > mu))


def forest_links(fps: np.ndarray, homes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the pairs (home, any) within the radius: row numbers."""
    label = np.arange(len(fps))
    us, vs = [], []
    for at in np.flatnonzero(homes):
        near = label[np.bitwise_count(fps ^ fps[at]) <= radius]
        low = near.min()
        if (near != low).any():
            for other in np.unique(near):
                if other != low:
                    us.append(other)
                    vs.append(low)
                    label[label == other] = low
    return np.array(us, np.int64), np.array(vs, np.int64)


def within(fps: np.ndarray, homes: np.ndarray, mask: int, part: int, radius: int):
    """Row numbers (with their homes) that meet in the leaves of a tree over the rows themselves."""
    depth = math.ceil(math.log2(max(1, int(homes.sum()) / INNER)))
    if depth <= 0:
        yield np.arange(len(fps)), homes
        return
    rng = np.random.default_rng(0)
    own = fps[homes]
    tree = grow(rng.choice(own, min(len(own), 32 << depth), replace=False), mask, depth + 2, rng)
    for _, rows, home in routed(fps, tree, mask, part):
        mine = homes[rows] & home
        if mine.any():
            yield rows, mine


def links(reps: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between the `first` documents of distinct fingerprints (fp, first), enough to span each component."""
    n = reps.count()
    depth = min(DEEP, max(SHALLOW, math.ceil(math.log2(max(1, n) / LEAF))))
    parts, trees = parts_of(radius, parts_for(n, radius)), []
    share = min(1.0, SAMPLES * 2**depth / max(n, 1))  # at most SAMPLES << DEEP fingerprints, about a million
    rows = reps.where(hash_keep(F.col("fp"), share, 42)).select("fp").toArrow()
    sample = np.sort(rows.column(0).to_numpy().view(np.uint64))
    for k, (mask, _) in enumerate(parts):
        trees.append(grow(sample, mask, depth + 2, np.random.default_rng(k)))

    def route(batches):
        for batch in batches:
            first, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for k, ((mask, r), tree) in enumerate(zip(parts, trees)):
                homes = np.zeros(len(fp), np.int64)
                found = list(routed(fp.view(np.uint64), tree, mask, r))
                for leaf, rows, home in found:
                    homes[rows[home]] = leaf
                for leaf, rows, home in found:
                    # a pair meets in both homes; of these the one with the lower number is enough
                    keep = leaf <= homes[rows]
                    rows, home = rows[keep], home[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf * len(parts) + k)), pa.array(home), pa.array(first[rows]), pa.array(fp[rows])], ["shard", "home", "first", "fp"])

    shards = written(reps.select("first", "fp").mapInArrow(frugal(route), "shard long, home boolean, first long, fp long"), "simhash-shards")
    # A shard with too many homes or rows is dealt out in cells (block of homes, block of all rows), so no task holds it whole.
    large = shards.groupBy("shard").agg(F.count_if("home").alias("h"), F.count("*").alias("n")).where((F.col("h") > HOMES) | (F.col("n") > ROWS))
    blocks = lambda c, most: F.coalesce(F.ceil(F.col(c) / most), F.lit(1)).cast("int")
    cut = shards.join(large, "shard", "left").select("shard", "first", "fp", "home", blocks("h", HOMES).alias("ki"), blocks("n", ROWS).alias("kj"))
    at = lambda k: F.pmod(F.xxhash64("fp", F.lit(7)), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    whole, dealt = cut.where("ki = 1 and kj = 1"), cut.where("ki > 1 or kj > 1")
    cells = (
        whole.select("shard", "first", "fp", "home", F.lit(0).alias("i"), F.lit(0).alias("j"))
        .unionByName(dealt.where("home").select("shard", "first", "fp", "home", at("ki").alias("i"), every("kj").alias("j")))
        .unionByName(dealt.select("shard", "first", "fp", F.lit(False).alias("home"), every("ki").alias("i"), at("kj").alias("j")))
    )

    def meet(table: pa.Table) -> pa.Table:
        first, fp, home = (table.column(x).to_numpy() for x in ("first", "fp", "home"))
        mask, part = parts[table.column("shard")[0].as_py() % len(parts)]
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, mine in within(fp.view(np.uint64), home, mask, part, radius):
            u, v = forest_links(fp.view(np.uint64)[rows], mine, radius)
            us.append(first[rows[u]])
            vs.append(first[rows[v]])
        return pa.table({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})

    return cells.groupBy("shard", "i", "j").applyInArrow(meet, "u long, v long").distinct()


def least_overlap(n: int, similarity: float) -> int:
    """Shingles that a set of n shares at least with any set that is so similar."""
    return math.ceil(similarity * n - 1e-9)


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and how frequent they are, in an eighth of the documents. They only order shingles: any order gives the same links."""

    def run(batches):
        for batch in batches:
            hashes = [np.unique(shingle_hashes(x or b"", shingle)) for x in as_bytes(batch.column(0))]
            found, n = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["token", "n"])

    some = docs.where(hash_keep(F.col("doc_id").cast("long"), 1 / 8, 31)).select(F.col("text").cast("string").alias("text"))
    rows = some.mapInArrow(frugal(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 4").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    tokens, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def shingle_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, fp, key, n, prefix, parity, fold): the key stands for the set of n distinct shingles; two sets so similar share one of their prefixes, the rarest shingles of each."""
    tokens, counts = common_shingles(docs, shingle)

    def run(batches):
        for batch in batches:
            rows = []
            for x in as_bytes(batch.column(1)):
                hashes = shingle_hashes(x or b"", shingle)
                found = np.unique(hashes)
                at = np.minimum(np.searchsorted(tokens, found), max(0, len(tokens) - 1))
                often = np.where(tokens[at] == found, counts[at], 0) if len(tokens) else np.zeros(len(found), np.int64)
                first = found[np.argsort(often, kind="stable")][: len(found) - least_overlap(len(found), similarity) + 1]
                rows.append((majority(hashes), set_key(found), len(found), first.tobytes(), parities(found), parities(found, SHORT)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())))], ["doc_id", "fp", "key", "n", "prefix", "parity", "fold"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, fp long, key long, n int, prefix binary, parity binary, fold binary")


def parities(found: np.ndarray, bits: int = 1024) -> bytes:
    """Whether an odd number of the shingles falls on each of so many bits; those of two sets differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((found >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def set_key(found: np.ndarray) -> int:
    """64 hashed bits of a sorted set of shingles, signed."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), 43)], np.uint64).view(np.int64)[0])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)
    return cut[:-1], cut[1:]


def shared_prefixes(sets: DataFrame, total: int) -> DataFrame:
    """(token, key, n, at) of the shingles that the prefixes of two sets share, of about `total` in all; at: the place in its set."""

    def deal(batches):
        for batch in batches:
            sizes, keys = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            prefixes = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            for at in range(0, len(keys), 1000):
                part = prefixes[at : at + 1000]
                lengths = np.array([len(x) for x in part])
                token = np.concatenate(part)
                place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(keys[at : at + 1000], lengths)), pa.array(np.repeat(sizes[at : at + 1000], lengths)), pa.array(place.astype(np.int32))], ["token", "key", "n", "at"])

    def met(table: pa.Table) -> pa.Table:
        token = table.column("token").to_numpy()
        order = np.argsort(token, kind="stable")
        begin, end = runs(token[order])
        return table.select(["token", "key", "n", "at"]).take(pa.array(np.sort(order[np.repeat(end - begin > 1, end - begin)])))

    tokens = sets.select("key", "n", "prefix").mapInArrow(frugal(deal), "token long, key long, n int, at int")
    return tokens.withColumn("bucket", F.pmod("token", F.lit(max(1, math.ceil(total / TOKENS))))).groupBy("bucket").applyInArrow(met, "token long, key long, n int, at int")


def pairs_apart(shared: DataFrame, labels: DataFrame, reps: DataFrame, similarity: float, spanning: bool = False) -> DataFrame:
    """(a, b): all pairs of sets with different labels that share a shingle of their prefixes and may be so similar; spanning: of these
    only enough to span the labels that they join, the likeliest of each set with a label first, so fewer than there are labels in a bucket.

    At the first shingle that two sets share nothing before it counts, so they share no more than what either has from there on,
    nor more than their short parities allow.
    """

    def pairs(table: pa.Table) -> pa.Table:
        token, key, n, at, label = (table.column(x).to_numpy() for x in ("token", "key", "n", "at", "label"))
        fold = np.frombuffer(b"".join(table.column("fold").to_pylist()), np.uint64).reshape(-1, SHORT // 64)
        order = np.lexsort((label, token))
        key, n, rest, label, fold = key[order], n[order].astype(np.int64), (n - at)[order].astype(np.int64), label[order], fold[order]

        def spare(x, y):
            """By how much the most that the rows x and y may share is over what they need; below 0: not so similar."""
            both = n[x] + n[y]
            o = np.minimum(rest[x], rest[y])
            o = np.minimum(o, (both - np.bitwise_count(fold[x] ^ fold[y]).sum(axis=-1, dtype=np.int64)) / 2)
            return o - similarity * (both - o) + 1e-6

        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        top = {x: x for x in np.unique(label).tolist()}  # of labels that a pair joins

        def root(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for a, b in zip(*runs(token[order])):
            begin, end = runs(label[a:b])
            if len(begin) == 1:
                continue
            for x, y in zip((a + begin).tolist(), (a + end).tolist()):
                for k in range(x, y if y < b else x):  # with all of later labels
                    room = spare(k, slice(y, b))
                    near = np.flatnonzero(room >= 0)
                    if spanning and len(near):
                        near = near[np.argsort(-room[near], kind="stable")]
                        near = near[np.sort(np.unique(label[y:b][near], return_index=True)[1])]  # the likeliest of each label
                        kept, own = [], root(int(label[k]))
                        for i in near.tolist():
                            if (other := root(int(label[y + i]))) != own:
                                top[other] = own
                                kept.append(i)
                        near = np.array(kept, np.int64)
                    us.append(np.full(len(near), key[k]))
                    vs.append(key[y:b][near])
        u, v = np.concatenate(us), np.concatenate(vs)
        both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    marks = reps.join(labels, reps["key"] == labels["node"], "left").select("key", F.coalesce("component", "key").alias("label"), "fold")
    named = shared.join(marks, "key").select("token", "key", "n", "at", "label", "fold")
    n = max(1, math.ceil(shared.count() / TOKENS))
    return named.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(n * 8))).groupBy("bucket").applyInArrow(pairs, "a long, b long").distinct()


def plausible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose parities do not rule the similarity out."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, 16) for k in (4, 5))
            most = (n + m - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) / 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(most >= similarity * (n + m - most) - 1e-6))

    x, y = (reps.select(F.col("key").alias(k), F.col("n").alias("n_" + k), F.col("parity").alias("of_" + k)) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(frugal(run), "a long, b long")


def similar(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets have a Jaccard similarity of `similarity` or more.

    Sets are compared row by row in the JVM, so that a task holds two sets at a time, however long the texts.
    """

    def run(batches):
        for batch in batches:
            keys, sets, held = [], [], 0
            for x in as_bytes(batch.column(0)):
                found = np.unique(shingle_hashes(x or b"", shingle))
                keys.append(set_key(found))
                sets.append(found.view(np.int64))
                held += len(found)
                if held > HELD:
                    yield rows_of(keys, sets)
                    keys, sets, held = [], [], 0
            yield rows_of(keys, sets)

    def rows_of(keys, sets):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        tokens = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), tokens)], ["key", "tokens"])

    asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    ids = written(reps.join(asked, "key", "left_semi").select(F.col("first").alias("wanted")).distinct(), "simhash-wanted")
    if ids.count() <= WANTED:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = written(texts.join(ids, texts["id"] == ids["wanted"], "left_semi").select("text").mapInArrow(frugal(run), "key long, tokens array<long>").dropDuplicates(["key"]), "simhash-sets")
    x, y = (sets.select(F.col("key").alias(k), F.col("tokens").alias("of_" + k)) for k in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    near = both >= similarity * (F.size("of_a") + F.size("of_b") - both) - 1e-9
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b")


def similar_components(fps: DataFrame, docs: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """(key, component_id) of the sets of shingles: the components of all pairs that are so similar.

    Pairs within the radius are asked first; they join most of a large group, so that the pairs that share
    a shingle of their prefixes, which is every similar one, need asking only where still apart.
    """
    reps = written(fps.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("parity").alias("parity"), F.min("fold").alias("fold")), "simhash-keys")
    one = written(reps.groupBy("fp").agg(F.min("key").alias("first")), "simhash-reps")
    same = reps.join(one.withColumnRenamed("first", "a"), "fp").select("a", F.col("key").alias("b")).where("a <> b")
    near = written(links(one, radius).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).unionByName(same).distinct(), "simhash-near")
    first = written(similar(near, docs, reps, shingle, similarity), "simhash-similar")
    labels = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")), "simhash-labels")
    firsts = reps.select(F.col("key").alias("of"), F.col("first").alias("id"))
    sets = fps.join(firsts, (fps["key"] == firsts["of"]) & (fps["doc_id"] == firsts["id"]), "left_semi")
    total = fps.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    shared = written(shared_prefixes(sets, total), "simhash-shared")
    # few pairs that span the labels of each bucket first: what they join needs no further asking, so a group is not expanded into its pairs
    span = written(plausible(pairs_apart(shared, labels, reps, similarity, spanning=True), reps, similarity), "simhash-span")
    first = written(first.unionByName(similar(span, docs, reps, shingle, similarity)), "simhash-similar")
    labels = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")), "simhash-labels")
    apart = written(plausible(pairs_apart(shared, labels, reps, similarity), reps, similarity), "simhash-pairs")
    dropped(docs.sparkSession, shared.shared_path)
    pairs = first.unionByName(similar(apart, docs, reps, shingle, similarity))
    ends = lambda k: reps.select(F.col("key").alias(k), F.col("first").alias("first_" + k))
    found = components(pairs.join(ends("a"), "a").join(ends("b"), "b").select(F.col("first_a").alias("u"), F.col("first_b").alias("v")), "simhash-components")
    return reps.join(found, reps["first"] == found["node"], "left").select("key", F.coalesce("component", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, similarity: float | None = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Documents link if the Jaccard similarity of their sets of shingles is `similarity` or more, exactly; with
    None, if their fingerprints differ in `radius` bits at most.
    """
    if similarity is not None:
        fps = written(shingle_sets(docs, shingle, similarity), "simhash-fps")
        named, by = similar_components(fps, docs, shingle, radius, similarity), "key"
    else:
        fps = written(fingerprints(docs, shingle), "simhash-fps")
        reps = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-reps")
        found = components(links(reps, radius), "simhash-components")
        named, by = reps.join(found, reps["first"] == found["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id")), "fp"
    return fps.join(named, by, "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hexed(fp):
    """16 lower-case hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
