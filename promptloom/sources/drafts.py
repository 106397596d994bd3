"""Reading and writing texts: any of Spark's formats as (key, text), at rest or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def drafts(rows: DataFrame, key: str | list[str], text: str | Column = "text") -> DataFrame:
    """Only what the engine needs: the key columns and `text`."""
    keys = [key] if isinstance(key, str) else key
    return rows.select(*keys, (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores where the scan has fewer splits than there are cores; larger tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < cores else rows


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row a file: its path and whole text."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def feeds(spark: SparkSession, path: str, schema: StructType | str, session: str = "session_id", ts: str = "ts", text: str = "text", files_a_batch: int = 100) -> DataFrame:
    """A stream of drafts (session_id, ts, text) from a growing folder of Parquet files."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return rows.select(F.col(session).alias("session_id"), F.col(ts).alias("ts"), F.col(text).alias("text"))


def values(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """Literal texts as (doc_id, text)."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def save(rows: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Findings or rewritten texts as Parquet."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
