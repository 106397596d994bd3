"""The engine in SQL: scalar functions, and table functions for LATERAL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..options import Options
from . import jsontext, minify, summary
from .bloat import Engine
from .frames import as_row
from .hygiene import find_hygiene
from .markup import normalize_unicode
from .prefix import cacheable_prefix_end

_FINDING = "start int, end int, original_text string, replacement string, kind string, severity string, message string, tokens_saved int, id string"
_NAMES = [x.split()[0] for x in _FINDING.split(", ")]


def _scalar(spark: SparkSession, name: str, make: Callable[[], Callable], returns: str = "string") -> None:
    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        call = make()
        return pd.Series([None if x is None else call(x) for x in texts.astype(object).where(texts.notna(), None)], dtype=object)

    spark.udf.register(name, run)


def register(spark: SparkSession, options: Options = Options()) -> None:
    """compress, the minifiers, summarize and cacheable_prefix_end as functions; find_bloat, find_hygiene and split_sentences as table functions."""
    _scalar(spark, "compress", lambda: Engine(options).compress)
    for name, function in (
        ("normalize_unicode", normalize_unicode),
        ("minify_json", jsontext.minify_json),
        ("minify_json_table", jsontext.minify_json_table),
        ("minify_yaml", minify.minify_yaml),
        ("minify_xml", minify.minify_xml),
        ("minify_markdown", minify.minify_markdown),
        ("minify_code", minify.minify_code),
        ("minify_csv", minify.minify_csv),
    ):
        _scalar(spark, name, lambda f=function: f)
    _scalar(spark, "summarize", lambda: lambda x: summary.summarize(x)[0])

    @F.pandas_udf("int")
    def prefix(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cacheable_prefix_end(x, y) for x, y in zip(a.astype(object).where(a.notna(), None), b.astype(object).where(b.notna(), None))])

    spark.udf.register("cacheable_prefix_end", prefix)

    @F.udtf(returnType=_FINDING)
    class FindBloat:
        def __init__(self):
            self.engine = Engine(options)

        def eval(self, text: str):
            for f in self.engine.find(text):
                row = as_row(f)
                yield tuple(row[n] for n in _NAMES)

    @F.udtf(returnType=_FINDING)
    class FindHygiene:
        def eval(self, text: str):
            for f in find_hygiene(text):
                row = as_row(f)
                yield tuple(row[n] for n in _NAMES)

    @F.udtf(returnType="sent_no int, start int, end int, text string")
    class SplitSentences:
        def eval(self, text: str):
            for k, s in enumerate(summary.split_sentences(text) if text else []):
                yield k, s.start, s.end, s.text

    spark.udtf.register("find_bloat", FindBloat)
    spark.udtf.register("find_hygiene", FindHygiene)
    spark.udtf.register("split_sentences", SplitSentences)
