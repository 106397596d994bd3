"""Span algebra as native expressions: arrays of struct<start, end, ...> in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import HYGIENE_KINDS


def match_spans(text: Column, pattern: str) -> Column:
    """Every match as (start, end, text), in order. The pattern must not match the empty string.

    Matches and the gaps between them interleave, so starts are running sums of their lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, p: F.when(
            p["m"].isNotNull(),
            F.struct(
                (acc["at"] + p["gap"] + F.length(p["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + F.length(p["m"])).alias("end"), p["m"].alias("text")))).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )


def merge_ranges(ranges: Column) -> Column:
    """Non-empty ranges sorted, overlapping and abutting ones joined; array<struct<start, end>>."""
    some = F.array_sort(F.transform(F.filter(ranges, lambda r: r["end"] > r["start"]), lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"))))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def join(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (r["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(some, empty, join)


def overlaps(ranges: Column, start: Column, end: Column) -> Column:
    """Whether a range overlaps [start, end); touching is no overlap."""
    return F.exists(ranges, lambda r: (start < r["end"]) & (end > r["start"]))


def finding_id(f: Column) -> Column:
    return F.coalesce(f["id"], F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))


def fits(text: Column, f: Column) -> Column:
    """Whether a finding still fits the text."""
    inside = (f["start"] >= 0) & (f["end"] <= F.length(text)) & (f["start"] <= f["end"])
    return inside & F.coalesce(F.substr(text, f["start"] + 1, f["end"] - f["start"]) == f["original_text"], F.lit(True))


def splice(text: Column, f: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), f["start"]), f["replacement"], F.substr(text, f["end"] + 1, F.greatest(F.length(text) - f["end"], F.lit(0))))


def apply_finding(text: Column, f: Column) -> Column:
    """The text with one finding applied, or as it is if that doesn't fit."""
    return F.when(fits(text, f), splice(text, f)).otherwise(text)


def apply_findings(text: Column, findings: Column, include: list[str] | None = None) -> Column:
    """All fitting findings from the end of the text to its start; without `include`, all but hazards."""
    wanted = F.filter(findings, lambda f: (f["kind"].isin(include) if include is not None else ~f["kind"].isin(*HYGIENE_KINDS)) & fits(text, f))
    ordered = F.sort_array(F.transform(wanted, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["replacement"].alias("replacement"))), asc=False)
    return F.aggregate(ordered, text, splice)


def added(before: Column, after: Column) -> Column:
    """Findings of `after` whose id `before` lacks."""
    known = F.transform(before, finding_id)
    return F.filter(after, lambda f: ~F.array_contains(known, finding_id(f)))


def removed(before: Column, after: Column) -> Column:
    return F.array_except(F.transform(before, finding_id), F.transform(after, finding_id))


def unchanged(before: Column, after: Column) -> Column:
    known = F.transform(before, finding_id)
    return F.filter(F.transform(after, finding_id), lambda i: F.array_contains(known, i))
