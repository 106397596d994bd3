"""Tables in the shared folder, Arrow helpers and connected components, used by the operators here."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset on a local master (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="promptloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/promptloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that written() or a sink made, once nothing reads it any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def given_back() -> None:
    """Give the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """The function for mapInArrow, whose worker gives the memory it has freed back to the system at the end of each task; idle workers live on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        given_back()

    return task


def frugal_group(run: Callable) -> Callable:
    """The same for applyInArrow, after each group."""

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        given_back()
        return out

    return group


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, row by row."""
    return column.cast(pa.binary()).to_pylist()


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One array of the bytes of all rows, and the offsets of the rows in it (null: empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, size: int):
    """Ranges of rows with about `size` bytes each, a longer row alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise."""
    x = x ^ (x >> np.uint64(30))  # a new array; all else in place
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_keep(column, fraction: float, seed: int):
    """A condition that holds for about this share of the keys, the same ones each time."""
    if fraction >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 20)) < F.lit(int(fraction * (1 << 20)))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of undirected edges (u, v); component: the smallest node reachable.

    Alternates large-star and small-star steps; each step aggregates before it shuffles, so a node
    with many links becomes one row a task. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = large.join(low, "u")
        small = pair.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then = written(small, name)
        state = tuple(then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        dropped(spark, now.shared_path)
        now = then
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
