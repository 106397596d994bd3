"""WARC archives of pages: records compressed one by one with a Zstandard dictionary held in the file.

An archive is a `.warc.zst` file: a skippable frame (magic 0x184D2A5D) with the dictionary first, then one
Zstandard frame a record. The dictionary is trained on whole records of a bounded sample, picked by hash from all
pages; of too few records, it is their bytes themselves. Spark's
own text writer makes the files, so that they land on whatever store the path names and lost tasks
leave nothing behind: a row is one frame, and the line separator is an empty skippable frame, which
every Zstandard reader passes over.

Of pages with equal payloads of `least` bytes or more, the one with the smallest page_id is a response; the
others are revisits that name it and carry no payload.

Defined results. Null html: an empty payload. Null url: an empty target. Null page_id: written and read
back as null; it counts as the largest, so it answers for others only if all their ids are null. Repeated page_ids: each
row makes a record; the rows of the smallest id among equal payloads are all responses. Very long payloads: whole, but
those over `largest` bytes don't train. Empty table: an empty archive folder, no rows. Columns other than page_id, url
and html are left out.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hash_keep, new_path, written

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame; as a line separator it is plain ASCII.
NOTHING = "P*M\x18\x00\x00\x00\x00"

RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDED = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has headers alone, and its length and digest are those of the payload it stands for."""
    key = "" if page_id is None else str(page_id)
    kind = RESPONSE if refers_to is None else REVISIT
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Target-URI: {target}", f"WARC-Date: {RECORDED}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {n_bytes}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Headers and payload of a record; raises if a response's payload isn't the one its header names."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == RESPONSE and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    urn = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    refers = fields.get("WARC-Refers-To")
    return {"page_id": urn(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": urn(refers) if refers else None}


def dictionary(samples: list[bytes], size: int = 64 << 10, segment: int = 256, gram: int = 8) -> bytes:
    """A dictionary of records by the cover algorithm; of too little to train one, the records' own bytes.

    Segment and gram are given: the search for the best of them may not end on small or uniform samples.
    """
    total = sum(map(len, samples))
    if len(samples) >= 8 and total >= 16 * segment and min(map(len, samples)) >= gram:
        try:
            return zstandard.train_dictionary(min(size, total // 10), samples, k=segment, d=gram).as_bytes()
        except zstandard.ZstdError:
            pass  # too uniform
    plain = b"".join(samples)[:size]
    return plain if len(plain) >= 8 else b""


def leading(trained: bytes) -> bytes:
    """The skippable frame that opens an archive."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained


def frames(content) -> Iterator[bytes]:
    """The records of an archive, from its bytes alone."""
    content = memoryview(content)
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(content):
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC and size:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(content[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        stream = reader.decompressobj()
        out = stream.decompress(content[at:])
        at = len(content) - len(stream.unused_data)
        yield out


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(id, key, first) of the rows that revisit another one: their page_id and digest, and the response's page_id. No payload is shuffled."""
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    known = pages.where(F.octet_length(F.col("html").cast("string")) >= least).select(F.col("page_id").cast("long").alias("id"), F.unhex(F.sha2(payload, 256)).alias("key"))
    first = known.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("key", "first")
    return known.join(first, "key").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "key", "first").distinct()


def referred(pages: DataFrame, least: int = 100, small: int = 64 << 20) -> DataFrame:
    """(page_id, url, payload, digest, n_bytes, refers_to): each page and the response that it revisits, if one.

    Up to `small` bytes of revisits are broadcast, so that payloads stay where they are; more meet the pages by page_id and
    digest, of which a hot payload has many.
    """
    found = written(revisits(pages, least), "warc-revisits")
    if found.count() * 100 <= small:
        found = F.broadcast(found)
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "n_bytes": F.octet_length("payload").cast("long")})
    named = rows.join(found, rows["page_id"].eqNullSafe(found["id"]) & (rows["digest"] == found["key"]), "left")
    return named.select("page_id", "url", F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), F.lower(F.hex("digest")).alias("digest"), "n_bytes", F.col("first").alias("refers_to"))


def write(pages: DataFrame, path: str, sample: int = 2_000, sample_bytes: int = 8 << 20, largest: int = 1 << 20, level: int = 3, least: int = 100) -> bytes:
    """Write archives to a folder; returns the dictionary. About `sample` pages of about `sample_bytes` in all train it, none over `largest` bytes."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    fit = rows.where(F.coalesce(F.octet_length("html"), F.lit(0)) <= largest)
    whole = fit.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("b")).first()
    share = min(1.0, sample / max(whole["n"], 1), sample_bytes / max(whole["b"] or 0, 1))
    some = []
    for row in fit.where(hash_keep(F.xxhash64("page_id", "url"), share, 11)).orderBy(F.xxhash64("page_id", "url"), "page_id", "url", "html").toLocalIterator():
        payload = (row["html"] or "").encode()
        some.append(record(row["page_id"], row["url"], payload, hashlib.sha256(payload).hexdigest(), len(payload), None))
    trained = dictionary(some)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=level)
        opened = False
        for batch in batches:
            out = [] if opened or not batch.num_rows else [leading(trained)]
            opened = opened or batch.num_rows > 0
            for row in batch.to_pylist():
                out.append(pack.compress(record(row["page_id"], row["url"], row["payload"], row["digest"], row["n_bytes"], row["refers_to"])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    made = referred(pages, least).mapInArrow(archive, "frame binary")
    made.select(F.expr("cast(frame as string)")).write.option("lineSep", NOTHING).option("compression", "none").option("maxRecordsPerFile", 0).text(path)
    return trained


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record in a folder of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], names)
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for raw in frames(content.as_buffer()):
                    found = parsed(raw)
                    del found["payload"]  # held against its digest by now
                    rows.append(found)
                    if len(rows) == 5_000:
                        yield as_batch(rows)
                        rows = []
                yield as_batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
