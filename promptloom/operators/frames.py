"""The engine over DataFrames: Arrow functions that keep a text in its row, so nothing is shuffled.

Each function compiles its rules once a task. A null text has null results and no findings; columns beside
the text stay. `findings_of` and its kin explode to one row a finding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import CHARS_PER_TOKEN, Hygiene, Options, SummaryOptions
from . import jsontext, minify, summary
from .bloat import Engine
from .dictionary import Rule
from .finding import Finding
from .hygiene import find_hygiene
from .markup import normalize_unicode
from .prefix import cacheable_prefix_end, longest_common_prefix
from .protect import protected_spans

FINDING = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("replacement", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("tokens_saved", T.IntegerType()),
        T.StructField("id", T.StringType()),
    ]
)
SPAN = "array<struct<start:int,end:int>>"
SENTENCE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("selected", T.BooleanType()),
    ]
)
ANALYSIS = T.StructType(
    [
        T.StructField("findings", T.ArrayType(FINDING)),
        T.StructField("compressed", T.StringType()),
        T.StructField("tokens_now", T.LongType()),
        T.StructField("tokens_after", T.LongType()),
        T.StructField("tokens_saved", T.LongType()),
    ]
)


def as_row(f: Finding) -> dict:
    row = f._asdict()
    return row | {"id": f.id or f"{f.kind}:{f.start}:{f.end}", "tokens_saved": int(f.tokens_saved)}


def _per_text(make: Callable[[], Callable[[str | None], object]], returns) -> Callable[[Column], Column]:
    """A column function that calls what `make` builds, once a task, on each text."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = make()
        for texts in batches:
            yield pd.Series([call(None if x is None or x is pd.NA else x) for x in texts.astype(object).where(texts.notna(), None)], dtype=object)

    return run


def _per_text_struct(make, returns: T.StructType) -> Callable[[Column], Column]:
    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = make()
        for texts in batches:
            rows = [call(x) for x in texts.astype(object).where(texts.notna(), None)]
            yield pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype=object) for k, name in enumerate(returns.names)})

    return run


def find_bloat(text: Column, options: Options = Options(), rules: Iterable[Rule] | None = None) -> Column:
    """array<finding>, by start."""
    rules = None if rules is None else list(rules)

    def make():
        engine = Engine(options, rules)
        return lambda x: [as_row(f) for f in engine.find(x)]

    return _per_text(make, T.ArrayType(FINDING))(text)


def compress(text: Column, options: Options = Options(), rules: Iterable[Rule] | None = None) -> Column:
    rules = None if rules is None else list(rules)
    return _per_text(lambda: Engine(options, rules).compress, "string")(text)


def analyze(text: Column, options: Options = Options(), rules: Iterable[Rule] | None = None) -> Column:
    """struct(findings, compressed, tokens_now, tokens_after, tokens_saved), from one run of the cascade."""
    rules = None if rules is None else list(rules)

    def make():
        engine = Engine(options, rules)

        def call(x):
            found, short, now, after = engine.analyze(x)
            return [as_row(f) for f in found], short, int(now), int(after), max(0, int(now) - int(after))

        return call

    return _per_text_struct(make, ANALYSIS)(text)


def hygiene(text: Column, wanted: Hygiene = Hygiene()) -> Column:
    return _per_text(lambda: lambda x: [as_row(f) for f in find_hygiene(x, wanted)], T.ArrayType(FINDING))(text)


def protected(text: Column) -> Column:
    return _per_text(lambda: lambda x: [{"start": a, "end": b} for a, b in protected_spans(x)] if x else [], SPAN)(text)


def sentences(text: Column) -> Column:
    returns = "array<struct<start:int,end:int,text:string,tokens:array<string>>>"
    return _per_text(lambda: lambda x: [s._asdict() for s in summary.split_sentences(x)] if x else [], returns)(text)


def summarize(text: Column, options: SummaryOptions = SummaryOptions()) -> Column:
    """struct(summary, sentences)."""
    returns = T.StructType([T.StructField("summary", T.StringType()), T.StructField("sentences", T.ArrayType(SENTENCE))])

    def make():
        def call(x):
            short, scored = summary.summarize(x, options)
            return short, [s._asdict() for s in scored]

        return call

    return _per_text_struct(make, returns)(text)


def _simple(function: Callable[[str | None], object], returns: str = "string") -> Callable[[Column], Column]:
    return lambda text: _per_text(lambda: function, returns)(text)


minify_json = _simple(jsontext.minify_json)
flatten_json_text = _simple(lambda x: jsontext.minify_json(x, "flatten"))
minify_json_table = _simple(jsontext.minify_json_table)
json_table = _simple(jsontext.json_table)
flatten_json = _simple(jsontext.flatten_json, "array<string>")
minify_yaml = _simple(minify.minify_yaml)
minify_xml = _simple(minify.minify_xml)
minify_markdown = _simple(minify.minify_markdown)
minify_code = _simple(minify.minify_code)
minify_csv = _simple(minify.minify_csv)
fold_unicode = _simple(normalize_unicode)


def extract_json(text: Column, start: Column) -> Column:
    """struct(json, end) of the JSON value at a place counted from 0; null fields where there is none."""

    @F.pandas_udf("json string, end int")
    def run(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for x, at in zip(texts, starts):
            found = jsontext.Blobs(x).value_at(int(at)) if x is not None and at == at and 0 <= at < len(x) and x[int(at)] in "[{" else None
            rows.append((jsontext.compact(found[0]), found[1]) if found else (None, None))
        return pd.DataFrame({"json": pd.Series([r[0] for r in rows], dtype=object), "end": pd.Series([r[1] for r in rows], dtype="Int32")})

    return run(text, start)


def unclosed_json(text: Column, start: Column) -> Column:
    """Whether the bracket at a place counted from 0 never closes."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([bool(x is not None and 0 <= at < len(x) and x[int(at)] in "[{" and jsontext.Blobs(x).unclosed(int(at))) for x, at in zip(texts, starts)])

    return run(text, start)


def common_prefix(a: Column, b: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([longest_common_prefix(p, q) if p is not None and q is not None else None for p, q in zip(x, y)], dtype=object)

    return run(a, b)


def cacheable_prefix(previous: Column, current: Column) -> Column:
    """Where the cacheable prefix ends; 0 without a previous version."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([cacheable_prefix_end(p, q) for p, q in zip(x.astype(object).where(x.notna(), None), y.astype(object).where(y.notna(), None))])

    return run(previous, current)


def findings_of(rows: DataFrame, keys: list[str], text: str = "text", options: Options = Options(), rules: Iterable[Rule] | None = None) -> DataFrame:
    """One row a finding: the keys and the finding's fields. Only keys and text go through Python."""
    return rows.select(*keys, find_bloat(F.col(text), options, rules).alias("f")).select(*keys, F.inline("f"))


def hazards_of(rows: DataFrame, keys: list[str], text: str = "text", wanted: Hygiene = Hygiene()) -> DataFrame:
    return rows.select(*keys, hygiene(F.col(text), wanted).alias("f")).select(*keys, F.inline("f"))


def sentences_of(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a sentence: the keys, sent_no and the sentence's fields."""
    return rows.select(*keys, F.posexplode(sentences(F.col(text))).alias("sent_no", "s")).select(*keys, "sent_no", "s.*")


def tokens(text: Column, tokenizer: Callable[[str], float] | Callable[[Column], Column] | None = None, native: bool = False) -> Column:
    """Token counts: the estimate, a column builder (native=True), or a Python callable."""
    if tokenizer is None:
        return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("bigint")
    return tokenizer(text) if native else _per_text(lambda: lambda x: None if x is None else int(tokenizer(x)), "bigint")(text)
