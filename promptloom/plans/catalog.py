"""All queries of the library over the test tables, by name, with DuckDB SQL for the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phrases, spans, text
from ..operators import frames, lines, terms
from ..operators.dictionary import default_rules
from ..options import HYGIENE_KINDS, Options, SummaryOptions
from ..sources.drafts import spread
from ..streaming import watcher
from . import augmented

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


AUGMENTED = f"({augmented.SQL})"

# ---- tokens and native text functions

ESTIMATE = "CAST(ceil(length(text) / 4.0) AS BIGINT)"


@query(f"SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum({ESTIMATE}) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_estimate_by_lang(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), F.sum(text.estimate_tokens(F.col("text"))).alias("tokens"))


@query(f"SELECT role, CAST(sum({ESTIMATE}) AS BIGINT) AS tokens, CAST(max({ESTIMATE}) AS BIGINT) AS longest FROM conversations GROUP BY role")
def token_estimate_by_role(spark, sf_dir):
    t = text.estimate_tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(t).alias("tokens"), F.max(t).alias("longest"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS tokens FROM documents")
def token_count_custom(spark, sf_dir):
    """A tokenizer given as a column builder."""

    def count(t):
        return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("bigint")

    return documents(spark, sf_dir).select("doc_id", frames.tokens(F.col("text"), count, native=True).alias("tokens"))


@query(f"SELECT doc_id, translate(replace(text, chr(8230), '...'), {literal(text.FOLD_FROM)}, {literal(text.FOLD_TO)}) AS text FROM {AUGMENTED}")
def normalize_unicode(spark, sf_dir):
    return augmented.documents(spark, sf_dir).select("doc_id", text.normalize_unicode(F.col("text")).alias("text"))


@query(
    f"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text
FROM {AUGMENTED}"""
)
def squeeze_whitespace(spark, sf_dir):
    return augmented.documents(spark, sf_dir).select("doc_id", text.squeeze(F.col("text")).alias("text"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->|<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), ' ') AS text FROM pages")
def xml_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.xml_text(F.col("html")).alias("text"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->|<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), ' ') AS text FROM pages")
def minify_xml(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", frames.minify_xml(F.col("html")).alias("text"))


@query("SELECT page_id, CAST(0 AS BIGINT) AS place, NOT regexp_matches(substr(html, 1, 0), '[A-Za-z0-9_$]') AS first, coalesce(NOT regexp_matches(substr(html, 5, 1), '[A-Za-z0-9_$]'), TRUE) AS fifth FROM pages")
def json_start(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.lit(0).cast("long").alias("place"), text.json_start(html, F.lit(0)).alias("first"), text.json_start(html, F.lit(5)).alias("fifth"))


# ---- spans by native expressions


def spans_sql(source: str, key: str, pattern: str, column: str = "text", where: str = "TRUE") -> str:
    """(key, start, end, match) of every match: lengths of matches and gaps added up."""
    return f"""
SELECT {key}, CAST(s AS BIGINT) AS "start", CAST(s + length(m) AS BIGINT) AS "end", m AS match FROM (
  SELECT {key}, list_extract(ms, i) AS m,
    list_sum(list_transform(list_slice(gs, 1, i), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda g: length(g))), 0) AS s
  FROM (SELECT {key}, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all({column}, {literal(pattern)}) AS ms, regexp_split_to_array({column}, {literal(pattern)}) AS gs FROM {source}))
) WHERE {where}"""


def found(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("original_text").alias("match"))


def native(rows: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    out = rows.select(key, F.inline(spans.match_spans(F.col(column), pattern)))
    return out.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").alias("match"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
COMMENT = r"<!--(?s:.*?)-->"


@query(spans_sql("pages", "page_id", COMMENT, "html"))
def html_comment_spans(spark, sf_dir):
    return native(table(spark, sf_dir, "pages"), "page_id", "html", COMMENT)


@query(spans_sql(AUGMENTED, "doc_id", EMAIL))
def email_spans_native(spark, sf_dir):
    return native(augmented.documents(spark, sf_dir), "doc_id", "text", EMAIL)


def hazards(spark, sf_dir) -> DataFrame:
    return frames.hazards_of(augmented.documents(spark, sf_dir), ["doc_id", "lang"])


@query(spans_sql(AUGMENTED, "doc_id", EMAIL))
def hygiene_email_spans(spark, sf_dir):
    return found(hazards(spark, sf_dir).where("message = 'Possible email address'"), "doc_id")


@query(spans_sql(AUGMENTED, "doc_id", r"\b(?:\+1[-.\s]?)?(?:\([0-9]{3}\)|[0-9]{3})[-.\s][0-9]{3}[-.\s][0-9]{4}\b"))
def hygiene_phone_spans(spark, sf_dir):
    return found(hazards(spark, sf_dir).where("message = 'Possible phone number'"), "doc_id")


@query(spans_sql(AUGMENTED, "doc_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"))
def hygiene_ssn_spans(spark, sf_dir):
    return found(hazards(spark, sf_dir).where("message = 'Possible Social Security number'"), "doc_id")


LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN (length(d) - k) % 2 = 0 THEN CAST(substr(d, k, 1) AS INT)
  ELSE CAST(substr(d, k, 1) AS INT) * 2 - CASE WHEN CAST(substr(d, k, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""


@query(f"SELECT doc_id, \"start\", \"end\", match FROM (SELECT *, regexp_replace(match, '[ \\t-]', '', 'g') AS d FROM ({spans_sql(AUGMENTED, 'doc_id', chr(92) + 'b(?:[0-9][ ' + chr(92) + 't-]*?){13,19}' + chr(92) + 'b')})) WHERE {LUHN}")
def hygiene_card_spans(spark, sf_dir):
    return found(hazards(spark, sf_dir).where("message = 'Possible credit card number'"), "doc_id")


SECRET = r"\b(?:sk-proj-[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|gh[po]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)\b"
INJECTION = r"(?i)ignore (?:all )?previous instructions|ignore (?:all )?(?:prior|above) (?:instructions|prompts)|you are now|reveal (?:your )?(?:system )?prompt|disregard (?:your )?(?:rules|guidelines|instructions)|\bjailbreak\b"


@query(spans_sql(AUGMENTED, "doc_id", SECRET))
def hygiene_secret_spans(spark, sf_dir):
    return found(hazards(spark, sf_dir).where("kind = 'secret'"), "doc_id")


@query(spans_sql(AUGMENTED, "doc_id", INJECTION))
def hygiene_injection_spans(spark, sf_dir):
    return found(hazards(spark, sf_dir).where("kind = 'injection'"), "doc_id")


@query(
    f"""
SELECT lang, kind, CAST(count(*) AS BIGINT) AS findings FROM (
  SELECT doc_id, 'secret' AS kind FROM ({spans_sql(AUGMENTED, 'doc_id', SECRET)})
  UNION ALL SELECT doc_id, 'injection' FROM ({spans_sql(AUGMENTED, 'doc_id', INJECTION)})
) JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, kind)"""
)
def hygiene_severity_rollup(spark, sf_dir):
    return hazards(spark, sf_dir).where("severity = 'critical'").rollup("lang", "kind").agg(F.count("*").alias("findings"))


@query()
def hygiene_findings(spark, sf_dir):
    """All hazards with all their fields."""
    return hazards(spark, sf_dir)


# ---- range algebra

RANGES = f"SELECT doc_id, \"start\" // 400 * 300 AS \"start\", \"end\" // 400 * 300 + 250 AS \"end\" FROM ({spans_sql('documents', 'doc_id', '[A-Z][a-z]+')})"


def derived_ranges(spark, sf_dir) -> DataFrame:
    words = native(documents(spark, sf_dir), "doc_id", "text", "[A-Z][a-z]+")
    return words.selectExpr("doc_id", "start div 400 * 300 AS start", "end div 400 * 300 + 250 AS end")


ISLANDS = f"""
WITH r AS (SELECT doc_id, "start", max("end") AS "end" FROM ({RANGES}) WHERE "end" > "start" GROUP BY ALL),
a AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
b AS (SELECT *, sum(CASE WHEN reach >= "start" THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT doc_id, CAST(min("start") AS BIGINT) AS "start", CAST(max("end") AS BIGINT) AS "end" FROM b GROUP BY doc_id, island"""


@query(ISLANDS)
def merge_ranges(spark, sf_dir):
    return lines.merged_ranges(derived_ranges(spark, sf_dir), "doc_id")


@query(ISLANDS)
def merge_ranges_native(spark, sf_dir):
    """The same as one expression over an array in each row."""
    docs = documents(spark, sf_dir).select("doc_id", spans.match_spans(F.col("text"), "[A-Z][a-z]+").alias("s"))
    moved = F.transform("s", lambda r: F.struct((F.floor(r["start"] / 400) * 300).cast("int").alias("start"), (F.floor(r["end"] / 400) * 300 + 250).cast("int").alias("end")))
    return docs.select("doc_id", F.inline(spans.merge_ranges(moved))).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    f"""
SELECT c.* FROM ({spans_sql('documents', 'doc_id', '[A-Za-z0-9.]+')}) c
WHERE NOT EXISTS (SELECT 1 FROM ({spans_sql('documents', 'doc_id', EMAIL)}) h WHERE h.doc_id = c.doc_id AND c."start" < h."end" AND c."end" > h."start")"""
)
def range_overlap_anti_join(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # an address needs its @; the pattern alone decides, but is slow on texts without one
    mails = lines.matches_of(docs.where(F.contains("text", F.lit("@"))), "doc_id", "text", EMAIL)
    return lines.matches_of(docs, "doc_id", "text", "[A-Za-z0-9.]+", hazards=mails)


# ---- dictionary

BOUNDARY = "A-Za-z0-9'" + chr(0x2019)


def phrase_pattern(kind: str) -> str:
    """Longest first, so that the first alternative is the longest match."""
    found = dict.fromkeys(r.phrase for r in default_rules() if r.kind == kind)
    ordered = sorted(found, key=lambda p: -len(p))
    return "|".join("".join(c if c.isalnum() or c in " '-," else "\\" + c for c in p) for p in ordered)


def doubled_pattern(kind: str) -> str:
    """The same where every character that is no word character stands twice, for an engine without look-around."""
    return "|".join("".join(c if c.isalnum() or c == "'" else c * 2 if c in " -," else "\\" + c + "\\" + c for c in p) for p in sorted(dict.fromkeys(r.phrase for r in default_rules() if r.kind == kind), key=lambda p: -len(p)))


WORDY = ("filler", "collapse", "contraction", "abbreviation", "hedge", "article")
PHRASES_SQL = " UNION ALL ".join(
    f"""
SELECT '{kind}' AS kind, regexp_replace(p, '([^{BOUNDARY.replace("'", "''")}])[^{BOUNDARY.replace("'", "''")}]', '\\1', 'g') AS phrase, CAST(count(*) AS BIGINT) AS hits
FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower(text), '([^{BOUNDARY.replace("'", "''")}])', '\\1\\1', 'g'), {literal(f"(?:^|[^{BOUNDARY}])({doubled_pattern(kind)})(?:[^{BOUNDARY}]|$)")}, 1)) AS p FROM {AUGMENTED}) GROUP BY ALL"""
    for kind in WORDY
)


@query(PHRASES_SQL)
def phrase_counts(spark, sf_dir):
    """Hits of each phrase of each kind on the raw text, by native expressions."""
    docs = augmented.documents(spark, sf_dir)
    hits = [
        docs.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?<![{BOUNDARY}])({phrase_pattern(kind)})(?![{BOUNDARY}])"), F.lit(1))).alias("phrase"))
        for kind in WORDY
    ]
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out.groupBy("kind", "phrase").agg(F.count("*").alias("hits"))


CASES = "SELECT * FROM (VALUES ('Despite', 'although', 'Although'), ('FOR EXAMPLE', 'e.g.', 'E.G.'), ('as soon as', 'ASAP', 'ASAP'), ('do not', 'don''t', 'don''t'), ('x', '', '')) t(original, replacement, cased)"


@query(CASES)
def cased(spark, sf_dir):
    rows = spark.createDataFrame([("Despite", "although"), ("FOR EXAMPLE", "e.g."), ("as soon as", "ASAP"), ("do not", "don't"), ("x", "")], "original string, replacement string")
    return rows.withColumn("cased", text.cased(F.col("original"), F.col("replacement")))


# ---- the cascade

STRICT = Options(strict=True, remove_articles=True)


@query()
def find_bloat(spark, sf_dir):
    return frames.findings_of(augmented.documents(spark, sf_dir), ["doc_id"])


@query()
def find_bloat_strict(spark, sf_dir):
    return frames.findings_of(augmented.documents(spark, sf_dir), ["doc_id"], options=STRICT)


def kind_query(name: str, kind: str, pattern: str, options: Options = Options()):
    """Findings of one kind whose shape is regular in the augmented texts."""

    def run(spark, sf_dir):
        return found(frames.findings_of(augmented.documents(spark, sf_dir), ["doc_id"], options=options).where(F.col("kind") == kind), "doc_id")

    run.__name__ = name
    query(spans_sql(AUGMENTED, "doc_id", pattern))(run)


ONLY = dict(abbreviations=False, hygiene=None, strip_markdown=False, dedupe_lines=False, minify_json=None)
kind_query("unicode_findings", "unicode", f"[{text.LOOKALIKES}]+", Options(**ONLY))
kind_query("json_findings", "json", r"\{\"name\": \"John\", \"age\": 30\}", Options(**ONLY | {"minify_json": "compact"}))
kind_query("table_findings", "table", r"\| a \| b \|\n\| --- \| --- \|\n\| 1 \| 2 \|", Options(**ONLY | {"strip_markdown": True}))
kind_query("aside_findings", "aside", "\\(by the way\\)|" + chr(0x2014) + " of course " + chr(0x2014), Options(**ONLY | {"strip_asides": True}))

@query()
def chrome_findings(spark, sf_dir):
    return found(frames.findings_of(augmented.documents(spark, sf_dir), ["doc_id"]).where("kind = 'chrome'"), "doc_id")


@query()
def dedupe_findings(spark, sf_dir):
    return found(frames.findings_of(augmented.documents(spark, sf_dir), ["doc_id"]).where("kind = 'dedupe'"), "doc_id")


@query()
def compress(spark, sf_dir):
    return augmented.documents(spark, sf_dir).select("doc_id", frames.compress(F.col("text")).alias("compressed"))


@query()
def apply_findings(spark, sf_dir):
    """Found in Python, applied by native expressions."""
    rows = augmented.documents(spark, sf_dir).select("doc_id", "text", frames.find_bloat(F.col("text")).alias("f"))
    return rows.select("doc_id", text.squeeze(spans.apply_findings(F.col("text"), F.col("f"))).alias("compressed"))


@query(f"SELECT doc_id, regexp_replace(text, {literal(EMAIL)}, '[mail]') AS applied FROM {AUGMENTED}")
def apply_finding(spark, sf_dir):
    """The first email replaced, as one finding."""
    rows = augmented.documents(spark, sf_dir).select("doc_id", "text", F.try_element_at(spans.match_spans(F.col("text"), EMAIL), F.lit(1)).alias("m"))
    f = F.struct(F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.text").alias("original_text"), F.lit("[mail]").alias("replacement"))
    return rows.select("doc_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(spans.apply_finding(F.col("text"), f)).alias("applied"))


@query()
def analyze(spark, sf_dir):
    rows = augmented.documents(spark, sf_dir).select("doc_id", frames.analyze(F.col("text")).alias("a"))
    return rows.select("doc_id", F.size("a.findings").alias("findings"), "a.tokens_now", "a.tokens_after", "a.tokens_saved")


@query()
def bloat_rollup(spark, sf_dir):
    """Findings and tokens saved by language and kind, with totals."""
    f = frames.findings_of(augmented.documents(spark, sf_dir), ["lang"])
    return f.rollup("lang", "kind").agg(F.count("*").alias("findings"), F.sum("tokens_saved").cast("long").alias("tokens_saved"))


@query()
def protected_ranges(spark, sf_dir):
    rows = augmented.documents(spark, sf_dir).select("doc_id", frames.protected(F.col("text")).alias("p"))
    return rows.select("doc_id", F.inline("p"))


@query(f"SELECT DISTINCT kind FROM (VALUES {', '.join(f'({literal(k)})' for k in HYGIENE_KINDS)}) t(kind)")
def hygiene_kinds(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in HYGIENE_KINDS], "kind string")


# ---- JSON and other payloads


@query("SELECT event_id, replace(props, ': ', ':') AS json FROM events")
def json_compact(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", frames.minify_json(F.col("props")).alias("json"))


@query("SELECT event_id, replace(replace(replace(replace(props, '\"', ''), ': ', ':'), '{', ''), '}', '') AS cells FROM events")
def json_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", frames.flatten_json_text(F.col("props")).alias("cells"))


@query("SELECT event_id, replace(replace(replace(replace(props, '\"', ''), ': ', ':'), '{', ''), '}', '') AS cell FROM events")
def json_cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(frames.flatten_json(F.col("props"))).alias("cell"))


def events_json(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    return rows.select("user_id", F.to_json("e").alias("json"))


EVENTS_CSV = "SELECT user_id, 'event_id,event_type' || chr(10) || string_agg(event_id || ',' || event_type, chr(10) ORDER BY event_id) AS csv FROM events GROUP BY user_id"


@query(EVENTS_CSV)
def json_table(spark, sf_dir):
    return events_json(spark, sf_dir).select("user_id", frames.json_table(F.col("json")).alias("csv"))


@query(EVENTS_CSV.replace("'event_id,event_type'", "'see event_id,event_type'"))
def json_table_in_prose(spark, sf_dir):
    return events_json(spark, sf_dir).select("user_id", frames.minify_json_table(F.concat(F.lit("see "), F.col("json"))).alias("csv"))


@query("SELECT event_id, replace(props, ': ', ':') AS json, CAST(length(props) + 2 AS INT) AS \"end\", FALSE AS open FROM events")
def json_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("x "), F.col("props")).alias("t"))
    return rows.select("event_id", frames.extract_json(F.col("t"), F.lit(2)).alias("j"), frames.unclosed_json(F.col("t"), F.lit(2)).alias("open")).select("event_id", "j.json", "j.end", "open")


PAYLOADS = (
    ("yaml", "# top\nname: John # c\nlist:\n  - a\nquoted: \"x # y\"\n\n\n\nz: |\n  raw", "name:John\nlist:\n  - a\nquoted:\"x # y\"\n\nz: |\n  raw"),
    ("code", "a = 1 // one\nb /* two */ = 'http://x'\n# note\n#include <x>\n\n\n\nc", "a = 1 \nb  = 'http://x'\n\n#include <x>\n\nc"),
    ("csv", " a , b ,\n,,\n1,\"2,3\",", 'a,b\n1,"2,3"'),
    ("tsv", "a\t b\t\n\t\t\n1\t2\t", "a\tb\n1\t2"),
    ("markdown", "**hi** there\n\n\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n", "hi there\n\na\tb\n1\t2"),
    ("xml", "<p>hello <!--x--> <b>world</b></p>", "hello world"),
    ("json", 'v {"b": 1.0, "1": [1, 2]} w', 'v {"1":[1,2],"b":1} w'),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({literal(f)}, {literal(out)})" for f, _, out in PAYLOADS) + ") t(format, minified)")
def minify_payloads(spark, sf_dir):
    rows = spark.createDataFrame([p[:2] for p in PAYLOADS], "format string, text string")
    by = {"yaml": frames.minify_yaml, "code": frames.minify_code, "csv": frames.minify_csv, "tsv": frames.minify_csv, "markdown": frames.minify_markdown, "xml": frames.minify_xml, "json": frames.minify_json}
    out = F.lit(None).cast("string")
    for name, function in by.items():
        out = F.when(F.col("format") == name, function(F.col("text"))).otherwise(out)
    return rows.select("format", out.alias("minified"))


@query()
def minify_markdown(spark, sf_dir):
    return augmented.documents(spark, sf_dir).select("doc_id", frames.minify_markdown(F.col("text")).alias("text"))


# ---- repeated lines

LINES = """
SELECT doc_id, CAST(n - 1 AS BIGINT) AS line_no, trimmed FROM (
  SELECT doc_id, n, trimmed, lag(trimmed) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM (
    SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, trim(unnest(l), ' ' || chr(9) || chr(13)) AS trimmed FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {source})))
WHERE trimmed <> '' AND trimmed = before"""


@query(LINES.format(source="documents"))
def dedupe_lines(spark, sf_dir):
    return lines.repeated_lines(documents(spark, sf_dir), "doc_id")


# ---- drafts: prefixes, deltas, debounce

TURNS = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations"
LCP = "coalesce(list_max(list_filter(range(0, least(length(previous), length(text)) + 1), lambda k: left(previous, k) = left(text, k))), 0)"


def turns(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("previous"))


@query(f"SELECT conv_id, turn, CAST({LCP} AS BIGINT) AS shared FROM ({TURNS})")
def prompt_lag_prefix(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.coalesce(text.prefix_length(F.col("previous"), F.col("text")), F.lit(0)).cast("long").alias("shared"))


@query(f"SELECT conv_id, turn, left(text, {LCP}) AS shared FROM ({TURNS}) WHERE previous IS NOT NULL")
def longest_common_prefix(spark, sf_dir):
    return turns(spark, sf_dir).where("previous is not null").select("conv_id", "turn", frames.common_prefix(F.col("previous"), F.col("text")).alias("shared"))


@query(
    f"""
SELECT conv_id, turn, CAST(CASE WHEN k > 0 AND k < length(text) AND regexp_matches(substr(text, k, 1), '[{BOUNDARY.replace("'", "''")}]') AND regexp_matches(substr(text, k + 1, 1), '[{BOUNDARY.replace("'", "''")}]')
  THEN length(regexp_replace(left(text, k), '[^ \\t\\n\\r]+$', '')) ELSE k END AS INT) AS cacheable
FROM (SELECT *, {LCP} AS k FROM ({TURNS}))"""
)
def cacheable_prefix(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", frames.cacheable_prefix(F.col("previous"), F.col("text")).alias("cacheable"))


@query(
    f"""
WITH m AS ({spans_sql('conversations', 'conv_id, turn', 'en')}),
t AS (SELECT conv_id, turn FROM conversations),
i AS (SELECT t.conv_id, t.turn, coalesce(list('en:' || "start" || ':' || "end") FILTER ("start" IS NOT NULL), []) AS ids FROM t LEFT JOIN m ON t.conv_id = m.conv_id AND t.turn = m.turn GROUP BY ALL),
p AS (SELECT *, coalesce(lag(ids) OVER (PARTITION BY conv_id ORDER BY turn), []) AS before FROM i)
SELECT conv_id, turn, CAST(len(list_filter(ids, lambda x: NOT list_contains(before, x))) AS INT) AS added, CAST(len(list_filter(before, lambda x: NOT list_contains(ids, x))) AS INT) AS removed,
  CAST(len(list_filter(ids, lambda x: list_contains(before, x))) AS INT) AS unchanged FROM p"""
)
def finding_delta(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,id:string>>)")
    marks = F.transform(spans.match_spans(F.col("text"), "en"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("en").alias("kind"), F.lit(None).cast("string").alias("id")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", marks.alias("now"))
    rows = rows.withColumn("before", F.coalesce(F.lag("now").over(w), none))
    before, now = F.col("before"), F.col("now")
    return rows.select("conv_id", "turn", F.size(spans.added(before, now)).alias("added"), F.size(spans.removed(before, now)).alias("removed"), F.size(spans.unchanged(before, now)).alias("unchanged"))


QUIET_S = 3600


@query(
    f"""
WITH g AS (SELECT user_id, ts, event_type || ':' || event_id AS text, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {QUIET_S} SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id AS session_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, max({{'a': ts, 'b': text}}).b AS text FROM s GROUP BY user_id, burst"""
)
def watcher_debounce(spark, sf_dir):
    feeds = table(spark, sf_dir, "events").select("user_id", "ts", F.concat_ws(":", "event_type", "event_id").alias("text"))
    last = watcher.debounced(feeds, session="user_id", debounce_ms=QUIET_S * 1000)
    return last.select("session_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "text")


@query()
def watcher_analysis(spark, sf_dir):
    """Turns as successive versions: findings, what changed, tokens and cacheable prefix."""
    versions = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text")
    rows = watcher.analyzed(versions, order="turn", keep=["session_id", "turn"])
    return rows.select("session_id", "turn", F.size("findings").alias("findings"), F.size("added").alias("added"), F.size("removed").alias("removed"), F.size("unchanged").alias("unchanged"), "tokens_now", "tokens_after", "tokens_saved", "cacheable_prefix_end")


# ---- sentences and summaries

STOP = "[" + ", ".join(literal(w) for w in sorted(phrases.STOPWORDS)) + "]"
TERMS = f"""
SELECT doc_id, line_no, term, len, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT doc_id, line_no, CAST(len(w) AS BIGINT) AS len, unnest(w) AS term FROM (
    SELECT doc_id, line_no, list_filter(list_transform(regexp_extract_all(line, '[A-Za-z0-9]+(?:[''{chr(0x2019)}][A-Za-z]+)?'), lambda x: replace(lower(x), chr(8217), '''')), lambda x: length(x) > 1 AND NOT list_contains({STOP}, x)) AS w
    FROM (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))) GROUP BY ALL"""
IDF = f"""
SELECT t.doc_id, term, CAST(count(*) AS BIGINT) AS df, ln((1 + any_value(n)) / (1.0 + count(*))) + 1 AS idf
FROM ({TERMS.replace('AS n FROM', 'AS k FROM')}) t JOIN (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) s ON t.doc_id = s.doc_id GROUP BY t.doc_id, term"""


def line_rows(spark, sf_dir) -> DataFrame:
    return lines.lines_of(documents(spark, sf_dir), "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("text"))


@query(TERMS)
def tokenize_terms(spark, sf_dir):
    return terms.terms_of(line_rows(spark, sf_dir), "doc_id", "line_no")


@query(f"SELECT doc_id, term, df, round(idf, 6) AS idf FROM ({IDF})")
def sentence_idf(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    return terms.idf_of(terms.terms_of(rows, "doc_id", "line_no"), rows, "doc_id").select("doc_id", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT doc_id, line_no, round(sum(n / CAST(len AS DOUBLE) * idf), 6) AS weight FROM ({TERMS}) JOIN ({IDF}) USING (doc_id, term) GROUP BY doc_id, line_no")
def sentence_tfidf(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    t = terms.terms_of(rows, "doc_id", "line_no")
    weights = terms.tfidf_of(t, terms.idf_of(t, rows, "doc_id"), "doc_id", "line_no")
    return weights.groupBy("doc_id", "line_no").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query(
    f"""
WITH v AS (SELECT doc_id, line_no, term, n / CAST(len AS DOUBLE) * idf AS w FROM ({TERMS}) JOIN ({IDF}) USING (doc_id, term)),
s AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
c AS (SELECT doc_id, term, sum(w) / any_value(n) AS m FROM v JOIN s USING (doc_id) GROUP BY doc_id, term),
k AS (SELECT doc_id, sqrt(sum(m * m)) AS norm FROM c GROUP BY doc_id)
SELECT doc_id, line_no, round(sum(w * m) / (sqrt(sum(w * w)) * any_value(norm)), 6) AS cosine FROM v JOIN c USING (doc_id, term) JOIN k USING (doc_id) GROUP BY doc_id, line_no"""
)
def sentence_centroid(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    return terms.centroid_cosine(rows, "doc_id", "line_no").select("doc_id", "line_no", F.round("cosine", 6).alias("cosine"))


@query(
    """
SELECT doc_id, line_no, round(CASE WHEN n <= 1 THEN 1.0 WHEN line_no = n - 1 THEN greatest(1 - line_no / CAST(n - 1 AS DOUBLE) * 0.7, 0.6) ELSE 1 - line_no / CAST(n - 1 AS DOUBLE) * 0.7 END, 6) AS score
FROM (SELECT doc_id, len(l) AS n, CAST(unnest(range(0, len(l))) AS BIGINT) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
)
def sentence_position(spark, sf_dir):
    rows = line_rows(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    return rows.select("doc_id", "line_no", F.round(terms.position_score(F.col("line_no"), F.col("n")), 6).alias("score"))


LINE_WORDS = "SELECT doc_id, unnest(range(0, len(l))) AS line_no, list_distinct(regexp_extract_all(lower(unnest(l)), '[a-z]+')) AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(
    f"""
SELECT a.doc_id, CAST(a.line_no AS BIGINT) AS line_no, round(CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) END, 6) AS likeness
FROM ({LINE_WORDS}) a JOIN ({LINE_WORDS}) b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 1"""
)
def jaccard_pairs(spark, sf_dir):
    """Likeness of each line to the next."""
    rows = line_rows(spark, sf_dir).select("doc_id", "line_no", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    pairs = rows.withColumn("v", F.lead("w").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("v is not null")
    return pairs.select("doc_id", "line_no", F.round(terms.jaccard(F.col("w"), F.col("v")), 6).alias("likeness"))


@query()
def split_sentences(spark, sf_dir):
    return frames.sentences_of(augmented.documents(spark, sf_dir), ["doc_id"]).drop("tokens")


def summary_query(name: str, options: SummaryOptions):
    def run(spark, sf_dir):
        rows = spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", frames.summarize(F.col("text"), options).alias("s"))
        return rows.select("doc_id", "s.summary", F.size("s.sentences").alias("sentences"), F.size(F.filter("s.sentences", lambda x: x["selected"])).alias("selected"))

    run.__name__ = name
    query()(run)


summary_query("summarize_fast", SummaryOptions())
summary_query("summarize_textrank", SummaryOptions(method="textrank", max_sentences=5))
summary_query("summarize_query", SummaryOptions(query="the and of", max_tokens=200))


@query(f"SELECT digits, {LUHN.replace('length(d)', 'length(digits)').replace('substr(d,', 'substr(digits,')} AND length(digits) BETWEEN 13 AND 19 AS ok FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{{10,}}')) AS digits FROM {AUGMENTED})")
def luhn_native(spark, sf_dir):
    rows = augmented.documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("([0-9]{10,})"), F.lit(1))).alias("digits"))
    return rows.select("digits", text.luhn(F.col("digits")).alias("ok"))
