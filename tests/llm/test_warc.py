import hashlib

import duckdb

from promptloom.llm import queries, warc
from promptloom.llm.shared import new_path

PAGES = [
    (3, "http://a", "x" * 100),
    (1, None, "x" * 100),
    (2, "http://b\r\nWARC-Type: evil", "x" * 100),
    (4, "http://c", "y" * 99),
    (5, "http://d", "y" * 99),
    (6, "http://e", None),
    (7, "http://f", ""),
    (8, "http://g", "\u00e9" * 50),
    (9, "http://h", "\u00e9" * 50),
    (9, "http://h", "\u00e9" * 50),
    (8, "http://g2", "\u00e9" * 50),
    (None, "http://i", "x" * 100),
    (10, "http://j", "z\r\n\r\n" * 50_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id long, url string, html string, digest string, payload string")


def test_round_trip(spark):
    got = [r.asDict() for r in warc.archived(frame(spark, PAGES)).collect()]
    assert len(got) == len(PAGES)
    want = []
    for page, url, html in PAGES:
        raw = (html or "").encode()
        first = {"x" * 100: 1, "\u00e9" * 50: 8}.get(html)
        to = first if first is not None and first != page else None
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)


def test_empty(spark):
    assert warc.archived(frame(spark, [])).count() == 0


def test_archives_open_with_the_dictionary_and_payloads_survive(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    path = new_path(spark, "warc-test")
    trained = warc.write(pages, path)
    assert trained
    found = {}
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        assert row.content[:8] == warc.leading(trained)[:8] and trained == row.content[8 : 8 + len(trained)]
        for raw in warc.frames(bytes(row.content)):
            r = warc.parsed(raw)
            found[r["page_id"]] = r
    for row in pages.collect():
        assert found[row.page_id]["payload"] == row.html.encode() and found[row.page_id]["url"] == row.url


def test_few_records_are_their_own_dictionary(spark):
    assert warc.dictionary([]) == b"" and warc.dictionary([b"abc" * 9]) == b"abc" * 9
    path = new_path(spark, "warc-few")
    own = warc.write(frame(spark, PAGES[:3]), path)
    assert own and b"x" * 100 in own
    assert warc.read(spark, path).count() == 3


def test_revisits_by_join_without_broadcast(spark, monkeypatch):
    rows = frame(spark, PAGES * 2)
    key = lambda r: (r.page_id is None, r.page_id or 0, r.digest, r.url or "")
    assert sorted(warc.referred(rows).collect(), key=key) == sorted(warc.referred(rows, small=0).collect(), key=key)


def test_against_sql(spark, small):
    got = sorted(map(tuple, queries.op1_warc(spark, small).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    want = sorted(con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({queries.SQL['op1_warc']})").fetchall())
    assert got == want
