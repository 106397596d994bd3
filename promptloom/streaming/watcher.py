"""Live drafts: debounce, analysis against the last analysed version, and the same over finished tables.

A draft settles when no newer version of its session came within the quiet time; only the last
version counts. In a stream that is a session window, closed by the watermark; versions that settled are then
analysed against the state of their session. Over a table, lag() stands for the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bloat import Engine
from ..operators.dictionary import Rule
from ..operators.finding import diff_findings
from ..operators.frames import FINDING, analyze, as_row, cacheable_prefix
from ..operators.prefix import cacheable_prefix_end
from ..functions.spans import added, removed, unchanged
from ..options import Options

DEBOUNCE_MS = 300

EVENT = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("text", T.StringType()),
        T.StructField("findings", T.ArrayType(FINDING)),
        T.StructField("added", T.ArrayType(FINDING)),
        T.StructField("removed", T.ArrayType(T.StringType())),
        T.StructField("unchanged", T.ArrayType(T.StringType())),
        T.StructField("tokens_saved", T.LongType()),
        T.StructField("compressed", T.StringType()),
        T.StructField("tokens_now", T.LongType()),
        T.StructField("tokens_after", T.LongType()),
        T.StructField("cacheable_prefix_end", T.IntegerType()),
    ]
)


def debounced(feeds: DataFrame, session: str = "session_id", ts: str = "ts", value: str = "text", debounce_ms: int = DEBOUNCE_MS, watermark: str = "1 second") -> DataFrame:
    """(session_id, ts, text): the last version of each burst; a gap of exactly the quiet time still joins, and of versions at one instant the greatest stands."""
    rows = feeds.withWatermark(ts, watermark) if feeds.isStreaming else feeds
    burst = F.session_window(F.col(ts), f"{debounce_ms} milliseconds")
    last = rows.groupBy(F.col(session).alias("session_id"), burst).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(value).alias("text"))).alias("last"))
    return last.select("session_id", "last.ts", "last.text")


def analyzed(settled: DataFrame, options: Options = Options(), rules: Iterable[Rule] | None = None, order: Column | str = "ts", keep: list[str] | None = None) -> DataFrame:
    """Every settled version with its findings, what changed since the one before, and the cacheable prefix."""
    keep = ["session_id", "ts"] if keep is None else keep
    order = F.col(order) if isinstance(order, str) else order
    run = settled.select(*keep, "text", analyze(F.col("text"), options, rules).alias("a")).select(*keep, "text", "a.*")
    w = Window.partitionBy("session_id").orderBy(order)
    none = F.array().cast(T.ArrayType(FINDING))
    past = run.withColumns({"before": F.coalesce(F.lag("findings").over(w), none), "previous": F.lag("text").over(w)})
    return past.select(
        *keep,
        "text",
        "findings",
        added(F.col("before"), F.col("findings")).alias("added"),
        removed(F.col("before"), F.col("findings")).alias("removed"),
        unchanged(F.col("before"), F.col("findings")).alias("unchanged"),
        "tokens_saved",
        "compressed",
        "tokens_now",
        "tokens_after",
        cacheable_prefix(F.col("previous"), F.col("text")).alias("cacheable_prefix_end"),
    )


def watched(feeds: DataFrame, options: Options = Options(), rules: Iterable[Rule] | None = None, debounce_ms: int = DEBOUNCE_MS, watermark: str = "1 second") -> DataFrame:
    """The stream of events for drafts (session_id, ts, text).

    One stateful operator debounces and analyses: a session's state is its pending version and the last
    text analysed. The pending one settles when a later version comes more than the quiet time behind it, or when the
    watermark has passed that time. A version older than the pending one is ignored.
    """
    rules = None if rules is None else list(rules)
    quiet = debounce_ms * 1000
    rows = feeds.withWatermark("ts", watermark).select(F.col("session_id").cast("string").alias("session_id"), "ts", F.unix_micros("ts").alias("us"), "text")
    out = T.StructType([T.StructField("us", T.LongType()) if f.name == "ts" else f for f in EVENT.fields])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine = Engine(options, rules)
        last, pending, pending_us = state.get if state.exists else (None, None, None)
        before = None
        events = []

        def settle() -> None:
            nonlocal last, before, pending, pending_us
            if before is None:
                before = engine.find(last) if last is not None else []
            found, short, now, after = engine.analyze(pending)
            new, gone, same = diff_findings(before, found)
            events.append((key[0], pending_us, pending, [as_row(f) for f in found], [as_row(f) for f in new], gone, same, max(0, int(now) - int(after)), short, int(now), int(after), cacheable_prefix_end(last, pending)))
            last, before, pending, pending_us = pending, found, None, None

        if not state.hasTimedOut:
            versions = pd.concat([b[["us", "text"]] for b in batches])
            for us, text in sorted((int(u), t) for u, t in zip(versions["us"], versions["text"]) if t is not None):
                if pending_us is not None and us - pending_us > quiet:
                    settle()
                if pending_us is None or us >= pending_us:
                    pending, pending_us = text, us
        due = None if pending_us is None else (pending_us + quiet) // 1000 + 1
        if due is not None and due <= state.getCurrentWatermarkMs():
            settle()
            due = None
        state.update((last, pending, pending_us))
        if due is not None:
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame(events, columns=out.names)

    found = rows.groupBy("session_id").applyInPandasWithState(step, out, "last string, pending string, pending_us long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*(F.timestamp_micros("us").alias("ts") if f.name == "ts" else f.name for f in EVENT.fields))


def listen(events: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hand every batch of events to a listener; stop() on the query ends it."""
    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(listener)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
