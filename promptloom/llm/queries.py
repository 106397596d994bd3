"""The queries opN_<name> over the test tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cws, langid, mixing, pieces, qualityrules, secretscan, simhash, suffixes, urlfilter, warc
from .shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4, similarity=None)
    return found.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.trained(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_cws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprinted(table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cleaned(table(spark, sf_dir, "documents"), length=100, bytes_too=False).drop("kept")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmented(table(spark, sf_dir, "documents"), pieces.vocabulary())


def op8_secretscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secretscan.scan(docs, secretscan.trained(docs))


#: Target shares of tokens by domain.
WEIGHTS = {"q1t0": 0.80, "q0t0": 0.14, "q1t1": 0.05, "q0t1": 0.01}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), weights=WEIGHTS)


def op10_qualityrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(qualityrules.counted(table(spark, sf_dir, "documents")), "quality-stats")
    rules = qualityrules.learned(stats, table(spark, sf_dir, "labels"))
    return qualityrules.judged(stats, rules).select("doc_id", *qualityrules.BASE, "base_failed", "kept", "rule")


QUERIES = {f.__name__: f for f in (op1_warc, op2_simhash, op3_langid, op4_urlfilter, op5_cws, op6_suffixes, op7_pieces, op8_secretscan, op9_mixing, op10_qualityrules)}

SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
""",
    "op4_urlfilter": urlfilter.duckdb_sql(),
}
