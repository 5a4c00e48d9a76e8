"""Pattern matches with offsets, as columns.

Offsets are code points, half-open, counted from 0. A match's place comes from the gaps that the same pattern leaves:
``split`` gives them in order, ``regexp_extract_all`` the matches between. Everything stays in the JVM; texts without
a match cost one search. The result is an array of (start, end, text, groups).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,text:string,groups:array<string>>>"
#: Word boundary of ASCII words only, whatever letters stand beside.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: White space with the no-break and Unicode spaces; a class's inside.
SPACES = r"\s\x0b   -     　﻿"


def laid_out(parts: Column, length: Callable[[Column], Column], build: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """``build(at, part)`` of every part of an array, ``at`` being the sum of the lengths before it; an array of ``kind``.

    An array that grows in a fold is copied with each step, so parts are folded in blocks and the blocks flattened.
    """
    count = F.greatest(F.size(parts), F.lit(0))
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.floor((count - 1) / block).cast("int")), lambda k: F.slice(parts, k * block + 1, F.lit(block))))
    inner = lambda at, b: F.aggregate(
        b,
        F.struct(at.alias("at"), F.array().cast(kind).alias("out")),
        lambda s, x: F.struct((s["at"] + length(x)).alias("at"), F.concat(s["out"], F.array(build(s["at"], x)).cast(kind)).alias("out")),
    )
    walked = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda s, b: F.element_at(F.transform(F.array(inner(s["at"], b)), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out"))), 1),
        lambda s: F.flatten(s["out"]),
    )
    return F.coalesce(walked, F.array().cast(kind))


def matches(text: Column, pattern: str, groups: int = 0) -> Column:
    """Leftmost non-overlapping matches. A group that takes no part is the empty string; null text has none.

    The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), found.alias("m"), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(f"g{i}") for i in range(groups))
    )
    parts = F.filter(zipped, lambda x: x["m"].isNotNull())
    caught = lambda x: F.array(*(x[f"g{i}"] for i in range(groups))).cast("array<string>")
    span = lambda at, x: F.struct(
        (at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["m"].alias("text"), caught(x).alias("groups")
    )
    walked = laid_out(parts, lambda x: F.length(x["gap"]) + F.length(x["m"]), span, MATCH)
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array().cast(MATCH))


def between(text: Column, separator: str) -> Column:
    """(start, end, text) of the stretches between the matches of a separator, the first and last included."""
    found = F.regexp_extract_all(text, F.lit(separator), F.lit(0))
    zipped = F.arrays_zip(F.split(text, separator, -1).alias("gap"), found.alias("m"))
    kind = "array<struct<start:int,end:int,text:string>>"
    span = lambda at, x: F.struct(at.alias("start"), (at + F.length(x["gap"])).alias("end"), x["gap"].alias("text"))
    return F.when(text.isNotNull(), laid_out(zipped, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0)), span, kind))


def texts(text: Column, pattern: str, group: int = 0) -> Column:
    """The matched texts alone, in order."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def count(text: Column, pattern: str) -> Column:
    return F.size(texts(text, pattern)).cast("long")


def escape(literal: str) -> str:
    """A pattern for the literal text."""
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-" else c for c in literal)


def occurrences(text: Column, literal: Column) -> Column:
    """Starts of the non-overlapping occurrences of a literal, from the left; empty for an empty literal or null."""
    gaps = F.split(text, F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    before = F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0)))
    starts = laid_out(before, lambda g: F.length(g) + F.length(literal), lambda at, g: at + F.length(g), "array<int>")
    return F.when(F.contains(text, literal) & (F.length(literal) > 0), starts).otherwise(F.array().cast("array<int>"))


def numbered(text: Column, literal: Column) -> Column:
    """(start, ordinal, line) of the non-overlapping occurrences of a literal: how many end before it, and its line from 1."""
    gaps = F.split(text, F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    before = F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0)))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    lines = laid_out(before, lambda g: breaks(g) + breaks(literal), lambda at, g: at + breaks(g) + 1, "array<int>")
    rows = F.arrays_zip(occurrences(text, literal).alias("start"), lines.alias("line"))
    found = F.transform(rows, lambda x, i: F.struct(x["start"].alias("start"), i.alias("ordinal"), x["line"].alias("line")))
    return F.when(F.contains(text, literal) & (F.length(literal) > 0), found).otherwise(F.array().cast("array<struct<start:int,ordinal:int,line:int>>"))


def occurrence_before(text: Column, literal: Column, start: Column) -> Column:
    """How many occurrences of the literal end at or before ``start`` (an ordinal for the one that starts there)."""
    before = F.substring(text, F.lit(1), start)
    return F.when(F.length(literal) > 0, ((F.length(before) - F.length(F.replace(before, literal, F.lit("")))) / F.length(literal)).cast("int")).otherwise(F.lit(0))


def run_before(text: Column, end: Column, inside: str, near: int = 64) -> Column:
    """The longest run of characters of the class ``inside`` that ends at an offset. Few are long, so what is near is
    looked at first, and the whole text only where the run fills that."""
    some = F.regexp_extract(F.substring(text, F.greatest(end - near, F.lit(0)) + 1, F.least(end, F.lit(near))), rf"[{inside}]*\z", 0)
    whole = F.reverse(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), end)), rf"^[{inside}]*", 0))
    return F.when(F.length(some) < near, some).otherwise(whole)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two (start, end) spans share a position."""
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def touches(a: Column, b: Column) -> Column:
    """Overlap, where an empty span touches what it lies strictly inside of."""
    inside = lambda x, y: (x["start"] == x["end"]) & (x["start"] > y["start"]) & (x["start"] < y["end"])
    return overlaps(a, b) | inside(a, b) | inside(b, a)


def within(a: Column, b: Column) -> Column:
    return (a["start"] >= b["start"]) & (a["end"] <= b["end"])


def any_span(spans: Column, test) -> Column:
    """Whether the test holds for any span of an array; false for null."""
    return F.coalesce(F.exists(spans, test), F.lit(False))


def char(text: Column, at: Column | int) -> Column:
    """The character at an offset; empty outside of the text."""
    return F.when(F.lit(at) >= 0 if isinstance(at, int) else at >= 0, F.substring(text, at + 1, F.lit(1))).otherwise(F.lit(""))


def line_and_place(text: Column, offset: Column) -> Column:
    """Line number, from 1, of an offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
