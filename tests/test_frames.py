"""The engine over DataFrames, native functions, SQL and streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from promptloom.functions import spans, text
from promptloom.operators import frames, lines, sql
from promptloom.operators.bloat import Engine
from promptloom.operators.finding import apply_findings
from promptloom.options import Options, SummaryOptions
from promptloom.plans import catalog
from promptloom.sources import drafts
from promptloom.streaming import watcher

TEXTS = ["please do not go", None, "", "say **hi** to ada@example.com", "“x”  y\n\n\n\nz", "do not\ndo not\ndo not", "\U0001f600 do not"]


@pytest.fixture(scope="module")
def rows(spark):
    return drafts.values(spark, TEXTS)


def test_compress_and_findings_agree_with_single_texts(rows):
    engine = Engine()
    got = {r.doc_id: r for r in rows.select("doc_id", frames.compress(F.col("text")).alias("c"), frames.analyze(F.col("text")).alias("a")).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k].c == engine.compress(t) == got[k].a.compressed
        assert len(got[k].a.findings) == len(engine.find(t))
    assert frames.findings_of(rows, ["doc_id"]).count() == sum(len(engine.find(t)) for t in TEXTS)


def test_native_apply_equals_python(rows):
    got = rows.select("doc_id", spans.apply_findings(F.col("text"), frames.find_bloat(F.col("text"))).alias("x")).collect()
    for r in got:
        t = TEXTS[r.doc_id]
        assert r.x == (None if t is None else apply_findings(t, Engine().find(t)))


def test_native_text_functions(spark):
    rows = spark.createDataFrame([(" a  b \n c \n\n\n\n d ",), ("“q”…​ x",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(text.squeeze(F.col("t")), text.normalize_unicode(F.col("t")), text.estimate_tokens(F.col("t"))).collect()]
    assert got[0][0] == "a b\nc\n\nd" and got[1][1] == '"q"... x' and got[2] == (None, None, None)


def test_match_spans_and_ranges(spark):
    one = spark.createDataFrame([("12 do not x do not",), ("",)], "t string").select(spans.match_spans(F.col("t"), "do not").alias("s"))
    assert [[(x.start, x.end) for x in r.s] for r in one.collect()] == [[(3, 9), (12, 18)], []]
    r = spark.createDataFrame([([(5, 7), (1, 3), (3, 4), (9, 9)],)], "r array<struct<start:int,end:int>>")
    assert [(x.start, x.end) for x in r.select(spans.merge_ranges(F.col("r")).alias("m")).first().m] == [(1, 4), (5, 7)]
    assert r.select(spans.overlaps(F.col("r"), F.lit(4), F.lit(5))).first()[0] is False


def test_relational_lines(spark):
    rows = spark.createDataFrame([(1, "a\n a \nb\n\n\nb"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in lines.repeated_lines(rows, "doc_id").collect()] == [(1, 1, "a")]


def test_sql_functions(spark, rows):
    sql.register(spark)
    rows.createOrReplaceTempView("drafts")
    assert spark.sql("SELECT compress(text) AS c FROM drafts WHERE doc_id = 0").first().c == "please don't go"
    found = spark.sql("SELECT d.doc_id, f.kind FROM drafts d, LATERAL find_bloat(d.text) f").collect()
    assert {(r.doc_id, r.kind) for r in found} >= {(0, "contraction"), (3, "chrome"), (3, "pii"), (4, "unicode")}
    assert spark.sql("SELECT count(*) FROM drafts d, LATERAL split_sentences(d.text) s").first()[0] >= 4
    assert spark.sql("SELECT cacheable_prefix_end('hello world', 'hello worms')").first()[0] == 6


def test_summaries_in_frames(rows):
    got = rows.select("doc_id", frames.summarize(F.col("text"), SummaryOptions()).alias("s")).collect()
    assert {r.doc_id: r.s.summary for r in got}[0] == "please do not go"
    assert {r.doc_id: r.s.summary for r in got}[1] is None


FEEDS = [
    ("a", 0, "please do not"),
    ("a", 100, "please do not go"),
    ("a", 5000, "please do not go away"),
    ("b", 0, "in order to win"),
    ("b", 301, "in order to win it"),
    ("a", 60_000, "end"),
    ("b", 60_000, "end"),
]
SCHEMA = "session_id string, ts timestamp, text string"


def feed_rows(spark):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, start + dt.timedelta(milliseconds=ms), t) for s, ms, t in FEEDS], SCHEMA)


def test_debounce_and_batch_events(spark):
    events = watcher.analyzed(watcher.debounced(feed_rows(spark))).collect()
    by = {(r.session_id, r.text): r for r in events}
    assert set(by) == {("a", "please do not go"), ("a", "please do not go away"), ("a", "end"), ("b", "in order to win"), ("b", "in order to win it"), ("b", "end")}
    first, second = by["a", "please do not go"], by["a", "please do not go away"]
    assert first.cacheable_prefix_end == 0 and len(first.added) == 1 and first.removed == []
    assert second.cacheable_prefix_end == len("please do not go") and second.added == [] and second.unchanged == ["contraction:7:13"]
    assert by["a", "end"].removed == ["contraction:7:13"]


def test_stream_equals_batch(spark, tmp_path):
    feed_rows(spark).repartition(1).write.parquet(str(tmp_path / "in"))
    seen = []
    events = watcher.watched(drafts.feeds(spark, str(tmp_path / "in"), SCHEMA))
    query = watcher.listen(events, lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "state"))
    query.awaitTermination(120)
    batch = watcher.analyzed(watcher.debounced(feed_rows(spark))).where("text <> 'end'").collect()
    key = lambda r: (r.session_id, r.text, [f.id for f in r.added], r.removed, r.unchanged, r.tokens_saved, r.compressed, r.cacheable_prefix_end)
    assert sorted(map(key, (r for r in seen if r.text != "end"))) == sorted(map(key, batch)) and len(batch) == 4


def test_options_off_means_kind_absent(spark, small):
    docs = catalog.augmented.documents(spark, small)
    off = Options(strip_markdown=False, dedupe_lines=False, minify_json=None, abbreviations=False, hygiene=None)
    kinds = {r.kind for r in frames.findings_of(docs, ["doc_id"], options=off).select("kind").distinct().collect()}
    assert not kinds & {"table", "chrome", "dedupe", "json", "abbreviation", "secret", "pii", "injection", "aside", "hedge", "article"}


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("do not\nx")
    assert drafts.text_files(spark, str(tmp_path / "t")).first().text == "do not\nx"
    drafts.save(drafts.values(spark, ["a"]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
