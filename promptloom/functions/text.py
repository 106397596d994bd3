"""Column functions over text: native Catalyst expressions, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import CHARS_PER_TOKEN

# White space as the engine trims and folds it, for Java regular expressions.
SPACE_CLASS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

FOLD_FROM = "\u00a0\u202f\u2007\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\ufeff\u200b\u200c\u200d\u2060"
FOLD_TO = "   ''''\"\"\"\""


#: All that folding touches.
LOOKALIKES = FOLD_FROM + "\u2026"


def estimate_tokens(text: Column) -> Column:
    """Four code points a token, rounded up; null stays null."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("bigint")


def normalize_unicode(text: Column) -> Column:
    """Look-alikes folded: what lies past the end of the second list is deleted."""
    return F.translate(F.replace(text, F.lit("\u2026"), F.lit("...")), FOLD_FROM, FOLD_TO)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\A[{SPACE_CLASS}]+", ""), rf"[{SPACE_CLASS}]+\z", "")


def squeeze(text: Column) -> Column:
    """Single spaces, none round line ends, one blank line at most, none at the edges."""
    text = F.regexp_replace(text, " +", " ")
    text = F.regexp_replace(text, " ?\n ?", "\n")
    return trim_space(F.regexp_replace(text, "\n{3,}", "\n\n"))


def xml_text(text: Column) -> Column:
    """Text between tags and comments on one line; from something never closed on, all stays."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->|(<!--.*)|<[^>]*>|(<.*)", "$1$2")
    return trim_space(F.regexp_replace(bare, rf"[{SPACE_CLASS}]+", " "))


def cased(original: Column, replacement: Column) -> Column:
    """The replacement in the casing of the original; acronyms stay."""
    acronym = (replacement == F.upper(replacement)) & replacement.rlike("[A-Z]")
    shouted = original.rlike("[A-Z]") & ~original.rlike("[a-z]")
    first = F.substring(original, 1, 1)
    return (
        F.when((replacement == "") | acronym, replacement)
        .when(shouted, F.upper(replacement))
        .when(first != F.lower(first), F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1 << 30)))
        .otherwise(replacement)
    )


def json_start(text: Column, index: Column) -> Column:
    """Whether JSON could start at a place, counted from 0: no word character before it."""
    return (index == 0) | ~F.substr(text, index, F.lit(1)).rlike("[A-Za-z0-9_$]")


def luhn(digits: Column) -> Column:
    """13 to 19 digits whose Luhn sum holds."""
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def code_tokens(text: Column, stopwords) -> Column:
    """Lower-cased words of two letters or more, without stop words, as the summarizer counts them."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+(?:['\u2019][A-Za-z]+)?)"), F.lit(1))
    folded = F.transform(words, lambda w: F.lower(F.translate(w, "\u2019", "'")))
    return F.filter(folded, lambda w: (F.length(w) > 1) & ~w.isin(*sorted(stopwords)))  # a hash set to Spark, no list


def prefix_length(a: Column, b: Column) -> Column:
    """Length of the common prefix, by doubling steps down from 2^24: a few comparisons of slices."""
    n = F.least(F.length(a), F.length(b))

    return F.aggregate(
        F.array(*(F.lit(1 << p) for p in range(24, -1, -1))),
        F.lit(0),
        lambda have, size: F.when((have + size <= n) & (F.substr(a, have + 1, size) == F.substr(b, have + 1, size)), have + size).otherwise(have),
    )
