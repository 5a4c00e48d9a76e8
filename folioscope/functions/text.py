"""Scalar text functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.matching import SPACES

ANY_SPACE = f"[{SPACES}]"


def sha256(text: Column) -> Column:
    """Digest with its scheme in front."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; there is no built-in."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _composed(text: Column, compose: bool) -> Column:
    return nfc(text) if compose else text


def normalize_text(text: Column, compose: bool = True) -> Column:
    """No byte order mark, composed, line feeds only, no spaces at line ends, at most one empty line, one final feed."""
    t = _composed(F.regexp_replace(text, "^﻿", ""), compose)
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)[ \t ]+(?=\n|\z)", "")
    return F.concat(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"\n+\z", ""), F.lit("\n"))


def normalize_quote(text: Column, compose: bool = True) -> Column:
    """Composed, runs of any white space as one space, trimmed."""
    return F.trim(F.regexp_replace(_composed(text, compose), ANY_SPACE + "+", " "))


def same_stem(a: Column, b: Column) -> Column:
    """Equal, or of one length and equal but for the last letter, or alike in their first six letters."""
    a, b = F.lower(a), F.lower(b)
    n, m = F.length(a), F.length(b)
    return (
        (a == b)
        | ((n == m) & (n > 1) & (F.substring(a, F.lit(1), n - 1) == F.substring(b, F.lit(1), n - 1)))
        | ((n >= 6) & (m >= 6) & (F.substring(a, 1, 6) == F.substring(b, 1, 6)))
    )


def one_edit_apart(a: Column, b: Column) -> Column:
    """One insertion, deletion or substitution apart."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b) == 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by bisection on lengths (about log2 n comparisons)."""
    top = F.least(F.length(a), F.length(b))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(20)),
        F.struct(F.lit(0).alias("lo"), top.alias("hi")),
        lambda s, _: F.when(
            s["lo"] < s["hi"],
            F.when(
                F.substring(a, F.lit(1), F.expr("1") * F.ceil((s["lo"] + s["hi"]) / 2).cast("int")) == F.substring(b, F.lit(1), F.ceil((s["lo"] + s["hi"]) / 2).cast("int")),
                F.struct(F.ceil((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi")),
            ).otherwise(F.struct(s["lo"].alias("lo"), (F.ceil((s["lo"] + s["hi"]) / 2).cast("int") - 1).alias("hi"))),
        ).otherwise(s),
        lambda s: s["lo"],
    )


def changed_span(target: Column, start: Column, replacement: Column) -> Column:
    """(start, end) of what an edit changes: the target without the prefix and suffix it shares with the replacement."""
    n = F.length(target)
    p = common_prefix(target, replacement)
    rest = lambda x: F.reverse(F.substring(x, p + 1, F.length(x)))
    q = common_prefix(rest(target), rest(replacement))
    return F.struct((start + p).alias("start"), (start + n - q).alias("end"))


def like_case(word: Column, replacement: Column) -> Column:
    """The replacement, with an upper-case first letter if the word has one."""
    upper = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))
    return F.when(F.regexp_like(word, F.lit(r"^\p{Lu}")), upper).otherwise(replacement)


def stable_id(fields: Column, length: int = 16) -> Column:
    """Id from a struct whose fields stand in the order of their names: its JSON's digest. Nulls are left out."""
    return F.substring(F.sha2(F.to_json(fields), 256), 1, length)


def line_of(text: Column, offset: Column) -> Column:
    """Line number, from 1, of an offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def splice(text: Column, edits: Column) -> Column:
    """Applies non-overlapping edits (start, end, replacement), given in order of start; offsets are the original's."""
    walked = F.aggregate(
        edits,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, e: F.struct(
            F.concat(s["out"], F.substring(text, s["at"] + 1, e["start"] - s["at"]), e["replacement"]).alias("out"), e["end"].alias("at")
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.coalesce(walked, text)


def strip_quotes(text: Column) -> Column:
    """Without one layer of quotation marks around it."""
    return F.trim(F.regexp_replace(F.trim(text), "^[«“\"'‘„]+|[»”\"'’“]+$", ""))


def fenced(text: Column) -> Column:
    """The inside of a Markdown code fence, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def uuid_of(text: Column) -> Column:
    """A UUID's shape from a digest."""
    h = F.sha2(text, 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))


def dictionary_key(text: Column) -> Column:
    """Lower case, straight apostrophes, single spaces."""
    return F.regexp_replace(F.translate(F.lower(text), "’", "'"), ANY_SPACE + "+", " ")


def mark_profile(text: Column) -> Column:
    """The text's marks alone: everything but letters, digits and white space."""
    return F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")


def multiset_equal(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def inserted_key(before: Column, after: Column) -> Column:
    """Words of the replacement that the target lacks, sorted and joined: what is reused across edits."""
    return F.array_join(F.array_sort(F.array_except(after, before)), " ")


def is_subsequence(part: Column, whole: Column) -> Column:
    """Whether all of ``part`` occurs in ``whole`` in order, with gaps allowed."""
    n = F.size(part)
    met = F.aggregate(whole, F.lit(0), lambda i, w: i + F.when((i < n) & F.get(part, i).eqNullSafe(w), 1).otherwise(0))
    return met == n


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance with swaps of neighbours, each stretch of letters being edited once."""

    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        before, last = [], list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            now = [i]
            for j, d in enumerate(y, 1):
                best = min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d))
                if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                    best = min(best, before[j - 2] + 1)
                now.append(best)
            before, last = last, now
        return last[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the text's code points (as units), as a long."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.lit(2166136261).cast("long"),
        lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long"), F.lit(4294967296).cast("long")),
    )
