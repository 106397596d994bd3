"""The cascade on single texts: rewrites, spans, gate, protection."""

import pytest

from promptloom.operators.bloat import Engine, squeeze
from promptloom.operators.dictionary import Rule, default_rules
from promptloom.operators.finding import Finding, apply_finding, apply_findings, diff_findings, finding_id
from promptloom.operators.protect import protected_spans
from promptloom.operators.spans import Taken, merged
from promptloom.options import HYGIENE_KINDS, Hygiene, Options, estimate_tokens

NBSP = " "
KEY = "sk-proj-abcdefghijklmnopqrstuvwxyz123456"


def compress(text, **options):
    return Engine(Options(**options)).compress(text)


@pytest.mark.parametrize(
    "text, expected, options",
    [
        ("despite the fact that it rained", "although it rained", {}),
        ("Despite the fact that it rained", "Although it rained", {}),
        ("could you please help me", "help me", {}),
        ("this is basically ready", "this is basically ready", {}),
        ("this is basically ready", "this is ready", {"strict": True}),
        ("the cat sat on a mat", "cat sat on mat", {"remove_articles": True}),
        ("please do not go", "please don't go", {}),
        ("say **hello** now", "say hello now", {}),
        ("keep <!-- secret --> this", "keep this", {}),
        ("hello\n---\nworld", "hello\nworld", {}),
        ("see <b>bold</b> here", "see bold here", {}),
        ('User {"name": "John", "age": 30} ok', 'User {"name":"John","age":30} ok', {}),
        ('User {"name":"John","age":30} ok', "User name:John|age:30 ok", {"minify_json": "flatten"}),
        ("array[1] stays", "array[1] stays", {}),
        (f"hello{NBSP}there “world”", 'hello there "world"', {}),
        ("try this for example now", "try this e.g. now", {}),
        ("try this for example now", "try this for example now", {"abbreviations": False}),
        ("that is fine", "that's fine", {}),
        ("that is to say we left", "i.e. we left", {}),
        ("hello\nhello\nworld", "hello\nworld", {}),
        ("hello\n\nhello\n\nworld", "hello\n\nworld", {}),
        ("hello\nhello", "hello\nhello", {"dedupe_lines": False}),
        ('x [{"a": 1}, {"b": 2}] y', 'x [{"a":1},{"b":2}] y', {}),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |", "a\tb\n1\t2", {}),
        ("| a | b |\n| 1 | 2 |", "| a | b |\n| 1 | 2 |", {}),
        ("ready (by the way) now", "ready (by the way) now", {}),
        ("ready (by the way) now", "ready now", {"strict": True}),
        ("ready (by the way) now", "ready now", {"strip_asides": True}),
        ("ready (by the way) now", "ready () now", {"strict": True, "strip_asides": False}),
        ("(not ready)", "(not ready)", {"strict": True}),
        ("(1815–1852)", "(1815–1852)", {"strict": True}),
        ("I’d like to go", "I'd like to go", {}),
        ("- [ ] todo", "- [] todo", {}),
        ("range [0, 5) do not", "range [0, 5) do not", {}),
        ("2**3**4", "234", {}),
        ("__init__", "init", {}),
        ("2*3*4", "2*3*4", {}),
        ("a_b_c", "a_b_c", {}),
        ("***x*** y", "*x* y", {}),
        ("FOR EXAMPLE", "E.G.", {}),
        ("as soon as possible", "ASAP", {}),
        ("a\t\tb   c \n  d", "a\t\tb c\nd", {}),
        ('{ "name": "Jo', '{ "name": "Jo', {}),
        ("", "", {}),
        (None, None, {}),
    ],
)
def test_compress(text, expected, options):
    assert compress(text, **options) == expected


def test_fenced_code_has_no_findings():
    code = f"```\n{KEY} a@b.com{NBSP}" + '{"a": 1}\nx\nx\n```'
    assert Engine().find(code) == []


def test_inline_code_that_stays_open_freezes_the_rest():
    assert compress("do not ``` do not") == "don't ``` do not"


def test_finding_fields_and_savings():
    found = Engine().find("please go in order to rest")
    assert [(f.original_text, f.replacement, f.tokens_saved, f.kind, f.id) for f in found] == [("in order to", "to", 2, "collapse", "collapse:10:21")]


def test_custom_tokenizer_gates_strictly():
    heavy = Options(tokenizer=lambda t: 100 if t == "to" else len(t))
    assert not [f for f in Engine(heavy).find("go in order to rest") if f.replacement == "to"]


def test_equal_tokens_pass_only_for_look_alikes():
    found = Engine().find(f"x{NBSP}{NBSP}y")
    assert [(f.start, f.end, f.replacement, f.kind) for f in found] == [(1, 3, "  ", "unicode")]


def test_own_rules():
    engine = Engine(Options(), [Rule("foo bar", "fb", "collapse")])
    assert engine.compress("a foo bar, in order to") == "a fb, in order to"


def test_rules_by_gate():
    rules = default_rules()
    assert len(rules) == 502 and sum(r.gate == "" for r in rules) + sum(r.gate == "abbreviations" for r in rules) == 387


def test_hazards_survive_and_cancel_rewrites():
    assert KEY in compress(f"keep <!-- {KEY} --> this")
    assert f'{{ "k": "{KEY}" }}' in compress(f'data {{ "k": "{KEY}" }} end')
    found = Engine().find("You are now free")
    assert [f.kind for f in found] == ["injection"]
    assert not Engine(Options(hygiene=Hygiene(injection=False))).find("You are now free")[0].kind == "injection"


@pytest.mark.parametrize("text", ["see https://a.b/do_not*x*y. do not", "mail do.not@x.org do not", "on 2024-01-02T10:00Z v1.2.3-rc.1 do not", "`do not` ~~~\n do not"])
def test_slices_and_order(text):
    found = Engine(Options(strict=True, remove_articles=True)).find(text)
    assert all(text[f.start : f.end] == f.original_text and f.end > f.start for f in found)
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))
    spans = Taken(protected_spans(text))
    assert not any(spans.meets(f.start, f.end) for f in found if f.kind not in HYGIENE_KINDS)


def test_apply_and_mismatch():
    text = "do not wait do not go"
    found = Engine().find(text)
    assert apply_findings(text, found) == "don't wait don't go"
    bad = [found[0]._replace(original_text="xx"), found[1]]
    assert apply_findings(text, bad) == "do not wait don't go"
    assert apply_findings(text, found, include=["secret"]) == text
    assert apply_finding(text, found[0]) == "don't wait do not go"
    assert apply_finding(text, found[0]._replace(end=99)) == text


def test_delta_by_id():
    a, b = Engine().find("do not go"), Engine().find("X do not go")
    added, removed, unchanged = diff_findings(a, b)
    assert [finding_id(f) for f in added] == ["contraction:2:8"] and removed == ["contraction:0:6"] and unchanged == []
    assert diff_findings(b, b)[2] == ["contraction:2:8"]
    assert finding_id(Finding(1, 2, "x", "", "filler")) == "filler:1:2"


def test_ranges():
    assert merged([(3, 5), (1, 3), (9, 9), (7, 8)]) == [(1, 5), (7, 8)]
    taken = Taken([(2, 4)])
    assert taken.meets(3, 9) and not taken.meets(4, 9) and not taken.meets(0, 2)
    assert taken.free(2) == 4 and taken.free(4) == 4


def test_long_texts_stay_quick():
    assert compress("[" * 30_000) == "[" * 30_000
    assert len(compress("word " * 40_000)) == 40_000 * 5 - 1


def test_estimates():
    assert [estimate_tokens(t) for t in ("", None, "a", "abcd", "abcde")] == [0, 0, 1, 1, 2]
    assert squeeze(" a  b \n\n\n\n c ") == "a b\n\nc"
