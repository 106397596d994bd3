"""Repeated lines and sessions of ranges as plain relational plans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_space


def lines_of(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, trimmed), one row a line."""
    return rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("trimmed", trim_space(F.col("line")))


def repeated_lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines equal, when trimmed, to the line right before; blank lines never count. The window stays within a document."""
    w = Window.partitionBy(key).orderBy("line_no")
    seen = lines_of(rows, key, text).withColumn("before", F.lag("trimmed").over(w))
    return seen.where((F.col("trimmed") != "") & (F.col("trimmed") == F.col("before"))).select(key, F.col("line_no").cast("long").alias("line_no"), "trimmed")


def merged_ranges(ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Islands of overlapping or abutting ranges, by key: (key, start, end)."""
    before = Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    # one range for each start: no ties, and less to shuffle
    longest = ranges.where(F.col(end) > F.col(start)).groupBy(key, start).agg(F.max(end).alias(end))
    some = longest.withColumn("reach", F.max(end).over(before))
    marked = some.withColumn("island", F.sum(F.when(F.col("reach") >= F.col(start), 0).otherwise(1)).over(upto))
    return marked.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def matches_of(rows: DataFrame, key: str, text: str, pattern: str, hazards: DataFrame | None = None) -> DataFrame:
    """(key, start, end, match) of every match in each row's text; with hazards (key, start, end), of those that overlap no hazard of their key.

    The pattern has no groups of its own and never matches the empty string. Only texts and hazards are dealt out by key: matches never
    leave their row, and are held against its key's hazards by binary search.
    """
    found = re.compile(f"({pattern})")
    kind = rows.schema[key].dataType.simpleString()
    none = F.expr("cast(array() as array<bigint>)")
    if hazards is None:
        asked = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), none.alias("starts"), none.alias("ends"))
    else:
        spans = hazards.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("_spans"))
        joined = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).join(spans, F.col("key") == F.col("_key"), "left")
        asked = joined.select("key", "text", F.coalesce("_spans.start", none).alias("starts"), F.coalesce("_spans.end", none).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                pieces = found.split(text)  # gaps and matches in turn
                sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
                end = np.cumsum(sizes)[1::2]
                start, match = end - sizes[1::2], pieces[1::2]
                if starts := batch.column(2)[i].as_py():
                    clear = np.flatnonzero(~overlapped(start, end, np.array(starts, np.int64), np.array(batch.column(3)[i].as_py(), np.int64)))
                    start, end, match = start[clear], end[clear], [match[k] for k in clear.tolist()]
                held.append((i, start, end, match))
                n += len(start)
                if n >= 100_000:
                    yield made(batch.column(0), held)
                    held, n = [], 0
            yield made(batch.column(0), held)

    def made(keys: pa.Array, held: list) -> pa.RecordBatch:
        cat = lambda k: np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)])
        row = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(cat(1)), pa.array(cat(2)), pa.array([m for h in held for m in h[3]], pa.string())], ["key", "start", "end", "match"])

    return asked.mapInArrow(run, f"key {kind}, start long, end long, match string").withColumnRenamed("key", key)


def overlapped(start: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each span [start, end) overlaps one of the others: whether the furthest end of those that start before its end lies past its start."""
    order = np.argsort(starts, kind="stable")
    reach = np.concatenate([[-1], np.maximum.accumulate(ends[order])])
    return reach[np.searchsorted(starts[order], end, "left")] > start
