"""Each row together with the next one by ascending id, without a window over the whole table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = -(2**63)

#: Bytes of text in a range of ids at least, their growth with the square root of all bytes, and ranges for each partition:
#: 100 TB are cut into 625,000 ranges of 160 MB, so that neither the splitters nor a task grows in proportion.
RANGE, GROWTH, EACH = 2 << 20, 16, 4


def with_next(docs: DataFrame, run: Callable[[list[tuple[int | None, bytes]], tuple[int | None, bytes]], pa.RecordBatch], schema: str, block: int = 1 << 20) -> DataFrame:
    """Calls run(rows, next) on consecutive rows of (doc_id, text in UTF-8) and the row behind them.

    Sampled splitters cut the ids into ranges of some MB of text (more for more text, as its square root); the first row of each range goes to the range
    before as well, the very first one to the last. So rows are dealt once, by range, and no task sees
    more than a few ranges. Null ids come first; rows of one id follow the order of their texts; a null
    text is empty. The row behind the last is the first (with one row: itself).
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_bytes = size["b"] or 0
    n_ranges = int(max(1, n_bytes // max(RANGE, GROWTH * math.isqrt(n_bytes)), math.isqrt(size["n"]) // 1000))
    cuts = []
    if n_ranges > 1:
        share = [i / n_ranges for i in range(1, n_ranges)]
        cuts = sorted(set(rows.agg(F.percentile_approx("k", share, max(10_000, 4 * n_ranges))).first()[0]))
    splits = np.array(cuts, np.int64)

    # a row at a splitter starts the range behind it
    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, k.to_numpy(np.int64), "right"))

    lows = [(r["r"], r["k"]) for r in rows.select("k").withColumn("r", range_of("k")).groupBy("r").agg(F.min("k").alias("k")).orderBy("r").collect()]
    before = {k: lows[i - 1][0] for i, (_, k) in enumerate(lows)}

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series) -> pd.Series:
        of = np.searchsorted(splits, k.to_numpy(np.int64), "right")
        return pd.Series([[2 * r, 2 * before[i] + 1] if i in before else [2 * r] for r, i in zip(of.tolist(), k.tolist())])

    dealt = rows.withColumn("t", F.explode(targets("k"))).withColumn("r", F.expr("t div 2")).repartition(max(1, n_ranges // EACH), "r").sortWithinPartitions("r", "t", "k", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        weight, now, done = 0, None, False
        for batch in batches:
            for k, text, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if t // 2 != now:
                    now, done = t // 2, False
                row = (None if k == NO_ID else k, text)
                if done:
                    continue  # further rows of the id that starts the next range
                if held and (t % 2 or weight >= block):
                    yield run(held, row)
                    held, weight = [], 0
                if t % 2:
                    done = True
                else:
                    held.append(row)
                    weight += len(text)

    return dealt.select("k", "text", "t").mapInArrow(walk, schema)
