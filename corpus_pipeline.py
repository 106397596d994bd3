"""A corpus pipeline over `documents`: language ID, near-duplicates, secrets, mixing, pieces.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and its result
is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results. Null texts count as empty: language ID rejects them. Null ids: no near-duplicates, one rate for all of
them. Rows that repeat an id: near-dedup keeps the least one by its other columns; elsewhere each counts. Ties: the
smallest id stays. Very long texts: whole. Empty tables: no rows. Further columns, whatever their names, go through
unchanged; n_chars is counted anew where secrets are masked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm import langid, mixing, pieces, secretscan, simhash
from promptloom.llm.shared import written

#: What mixing aims at: each domain's expected tokens times this. Clean text weighs more, so none of it goes.
FACTORS = {"q1t0": 1.5, "q0t0": 0.5, "q1t1": 0.5, "q0t1": 0.25}


def reserved(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def with_decision(docs: DataFrame, decisions: DataFrame, decision: str) -> tuple[DataFrame, str]:
    """The documents with what was decided by id, and its column; rows that repeat an id share it, and null ids meet nulls."""
    key, value = reserved(docs, "decided_id"), reserved(docs, "decided")
    once = decisions.groupBy(F.col("doc_id").alias(key)).agg(F.first(decision).alias(value))
    return docs.join(once, F.col("doc_id").eqNullSafe(F.col(key)), "left").drop(key), value


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model doesn't reject."""
    return langid.accepted(docs, langid.trained(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of 0.8 or more, shingles of five words) the document with the smallest id."""
    found = simhash.near_duplicates(docs, shingle=5, radius=4, similarity=0.8)
    key = reserved(docs, "kept_id")
    kept = found.where(F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))).select(F.col("doc_id").alias(key)).distinct()
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
    count, row = reserved(docs, "count"), reserved(docs, "row")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(count)).where(F.col(count) > 1).limit(1).count()
    if not repeated:
        return out
    least = out.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*(F.col(c) for c in docs.columns if c != "doc_id"))).alias(row))
    return least.select("doc_id", f"{row}.*").select(*docs.columns).unionByName(out.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret replaced by its kind in brackets."""
    return secretscan.masked(docs, secretscan.trained(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its rate asks for."""
    rates = mixing.weighted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), factors=FACTORS)
    dealt, copies = with_decision(docs, rates, "copies")
    return dealt.where(F.col(copies) > 0).withColumn(reserved(dealt, "copy"), F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document."""
    return pieces.segmented(docs, pieces.vocabulary())


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoded),
]

#: Trained models and sampled pieces are beyond SQL. Tests hold near-dedup, copies and decoded pieces against plain versions here, and the
#: models' scores against plain forward passes with the operators' own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
