"""Terms, frequencies and TF-IDF of sentences as relational plans, for tables of sentences rather than single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phrases import STOPWORDS
from ..functions.text import code_tokens


def terms_of(sentences: DataFrame, doc: str, sent: str, text: str = "text") -> DataFrame:
    """(doc, sent, term, n, len): counts of each term in each sentence and the sentence's length in terms."""
    words = sentences.select(doc, sent, code_tokens(F.col(text), STOPWORDS).alias("tokens"))
    return words.select(doc, sent, F.size("tokens").cast("long").alias("len"), F.explode("tokens").alias("term")).groupBy(doc, sent, "len", "term").agg(F.count("*").alias("n"))


def idf_of(terms: DataFrame, sentences: DataFrame, doc: str) -> DataFrame:
    """(doc, term, df, idf): ln((1 + sentences) / (1 + df)) + 1, within each document."""
    n = sentences.groupBy(doc).agg(F.count("*").alias("sentences"))
    df = terms.groupBy(doc, "term").agg(F.count("*").alias("df"))
    return df.join(n, doc).select(doc, "term", "df", (F.log((1 + F.col("sentences")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_of(terms: DataFrame, idf: DataFrame, doc: str, sent: str) -> DataFrame:
    """(doc, sent, term, weight)."""
    return terms.join(idf, [doc, "term"]).select(doc, sent, "term", (F.col("n") / F.col("len") * F.col("idf")).alias("weight"))


def centroid_cosine(sentences: DataFrame, doc: str, sent: str, text: str = "text") -> DataFrame:
    """(doc, sent, cosine): likeness of each sentence's TF-IDF vector to the mean of its document's vectors.

    Sentences are dealt out by document once, before they are split into terms; all counts and sums are then windows and groups within
    a document. The mean's squared norm is the mean of its products with the vectors. Null documents have no rows.
    """
    # a fixed number of partitions: joined into larger ones, terms wouldn't fit in memory when sorted
    parts = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sentences.where(F.col(doc).isNotNull()).select(doc, sent, text).repartition(parts, doc)
    n = F.count("*").over(Window.partitionBy(doc)).alias("sentences")
    words = dealt.select(doc, sent, text, n).select(doc, sent, "sentences", code_tokens(F.col(text), STOPWORDS).alias("tokens"))
    # an outer explode, since Spark filters by the size of the array before an inner one, and so makes the tokens twice
    terms = words.select(doc, sent, "sentences", F.size("tokens").cast("long").alias("len"), F.explode_outer("tokens").alias("term"))
    terms = terms.where("term is not null").groupBy(doc, sent, "sentences", "len", "term").agg(F.count("*").alias("n"))
    same = Window.partitionBy(doc, "term")
    idf = F.log((1 + F.col("sentences")) / (1 + F.count("*").over(same))) + 1
    weights = terms.select(doc, sent, "term", "sentences", (F.col("n") / F.col("len") * idf).alias("weight"))
    means = weights.select(doc, sent, "sentences", "weight", (F.sum("weight").over(same) / F.col("sentences")).alias("m"))
    dots = means.groupBy(doc, sent, "sentences").agg(F.sum(F.col("weight") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    mean_norm = F.sqrt(F.sum("dot").over(Window.partitionBy(doc)) / F.col("sentences"))
    return dots.select(doc, sent, (F.col("dot") / (F.col("norm") * mean_norm)).alias("cosine"))


def position_score(index, n):
    """1 falling to 0.3 along the document; the last sentence has 0.6 at least."""
    lead = 1 - index / (n - 1) * 0.7
    return F.when(n <= 1, F.lit(1.0)).when(index == n - 1, F.greatest(lead, F.lit(0.6))).otherwise(lead)


def jaccard(a, b):
    """Of two token arrays; two empty ones are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
