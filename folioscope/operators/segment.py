"""Texts cut into scenes, paragraphs, sentences, words, dialogue and occurrences; all with code-point offsets.

Arrays are built inside the row and exploded by the caller or by the ``*_table`` functions, so cutting a text never
shuffles it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.matching import MATCH, between, matches, texts, within
from folioscope.functions.text import normalize_text, sha256
from folioscope.operators.lexicon import Pack

#: Clock times, dates and decimals stay whole; letters with inner apostrophes; digits. Edges are those of ASCII words.
_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
WORD = rf"{_B}[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?{_B}|{_B}[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}{_B}|{_B}[0-9]+(?:[.,][0-9]+)+{_B}|\p{{L}}+(?:['’]\p{{L}}+)*|[0-9]+"
MARKER = r"(?m)^<!--[ \t]*scene:[ \t]*([^\s]+)[ \t]*-->[ \t]*(?:\r?\n|\z)"
SPEECH_LINE = r"(?m)^\s*[—–-][ \t]+[^\r\n]+"


def _list(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


def words(text: Column) -> Column:
    """The words' texts, in order."""
    return texts(text, WORD)


def lower_words(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.lower(w))


SPANS = _list(start=T.IntegerType(), end=T.IntegerType(), text=T.StringType(), lower=T.StringType())


def spans_of(texts: pa.Array) -> pa.Array:
    """Words of an array of texts with their places, as flat columns: no object is kept for a word."""
    import regex

    walk = regex.compile(WORD).finditer
    counts, starts, ends, found = array("i", [0]), array("i"), array("i"), []
    for t in texts.to_pylist():
        for m in walk(t or ""):
            starts.append(m.start())
            ends.append(m.end())
            found.append(m[0])
        counts.append(len(found))
    fields = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string()), pa.array([w.lower() for w in found], pa.string())]
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "text", "lower"]))


@F.arrow_udf(SPANS)
def word_spans(text: pa.Array) -> pa.Array:
    """Words with their places. A text has many, so they are walked once, in Arrow batches."""
    return spans_of(text)


def tokens_table(docs: DataFrame, keys: list[str], text_col: str = "text", portion: int = 1 << 18) -> DataFrame:
    """keys, pos, start, end, text, lower: a row for each word.

    A word takes many times its own size, so texts are walked about ``portion`` characters at a time, however large the
    engine's batches are.
    """
    rows = docs.select(*keys, F.col(text_col).alias("_t"))
    kept = T.StructType([*rows.schema.fields[:-1], T.StructField("_w", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.binary_length(b.column(len(keys))).fill_null(0).to_numpy().astype(np.int64))
            edges = [0, *(np.flatnonzero(np.diff(upto // portion)) + 1).tolist(), len(b)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if y > x:
                    part = b.slice(x, y - x)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], spans_of(part.column(len(keys)))], [*keys, "_w"])

    walked = rows.mapInArrow(run, kept)
    return walked.select(*keys, F.posexplode("_w").alias("pos", "w")).select(*keys, "pos", "w.start", "w.end", "w.text", "w.lower")


def scenes(text: Column) -> Column:
    """(scene_id, start, end, implicit, text): text between scene markers; what stands before the first is ``s0``."""
    marks = matches(text, MARKER, 1)
    n = F.length(text)
    spans = F.transform(
        marks,
        lambda m, i: F.struct(
            m["groups"][0].alias("scene_id"), m["end"].alias("start"), F.coalesce(F.get(marks, i + 1)["start"], n).alias("end"), F.lit(False).alias("implicit")
        ),
    )
    head = lambda end: F.array(F.struct(F.lit("s0").alias("scene_id"), F.lit(0).alias("start"), end.alias("end"), F.lit(True).alias("implicit")))
    first = F.get(marks, 0)["start"]
    whole = F.when(F.size(marks) == 0, head(n)).when(first > 0, F.concat(head(first), spans)).otherwise(spans)
    return F.transform(whole, lambda s: F.struct(s["scene_id"].alias("scene_id"), s["start"].alias("start"), s["end"].alias("end"), s["implicit"].alias("implicit"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def scenes_table(chapters: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, scene_ord, scene_id, start, end, implicit, text, content_hash."""
    rows = chapters.select(*keys, F.posexplode(scenes(F.col(text_col))).alias("scene_ord", "s")).select(*keys, "scene_ord", "s.*")
    return rows.withColumn("content_hash", sha256(normalize_text(F.col("text"))))


def paragraphs(text: Column) -> Column:
    """(start, end, text) of paragraphs: stretches between empty lines that aren't blank."""
    parts = between(text, r"(?:\r?\n){2,}")
    return F.filter(parts, lambda p: F.length(F.trim(F.regexp_replace(p["text"], r"\s+", " "))) > 0)


def sentences(text: Column, pack: Pack) -> Column:
    """(start, end, text): a rule-based stand-in for a full segmenter.

    A sentence ends after ! or ?, after a full stop not followed by a lower-case word, each with closing marks, and at
    line ends. One that ends in an abbreviation of the pack takes in the next. Blank ones go.
    """
    close = r"[\"'”’»)\]]*"
    end = rf"(?:[!?]+[.!?…]*{close}|[.]+{close}(?!\s+[\p{{Ll}}]))(?:\s+|\z)"
    base = matches(text, rf"(?s)[^\n]+?(?:{end}|\n+|\z)|\n+")
    short = F.array(*(F.lit(a.lower()) for a in pack.abbreviations)).cast("array<string>")
    kind = "array<struct<start:int,end:int,text:string>>"
    last = lambda done: F.element_at(done, -1)
    joined = F.aggregate(
        base,
        F.array().cast(kind),
        lambda done, s: F.when(
            (F.size(done) > 0) & F.array_contains(short, F.lower(F.element_at(F.split(F.trim(F.regexp_replace(last(done)["text"], r"\s+", " ")), " "), -1))),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), s["end"].alias("end"), F.concat(last(done)["text"], s["text"]).alias("text")))),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))),
    )
    return F.filter(joined, lambda s: F.length(F.trim(F.regexp_replace(s["text"], r"\s+", " "))) > 0)


def dialogue(text: Column, pack: Pack) -> Column:
    """(start, end, text, groups) of quotations of each pair of marks, and of lines that open with a dash, by start.

    A backslash takes the next character out. Inside an open quotation further openers count for nothing, and one that
    is never closed is none.
    """
    found = []
    for opener, closer in pack.quote_pairs:
        o, c = _literal(opener), _literal(closer)
        # written as a class and its exceptions, so the engine loops instead of recursing over long quotations
        inside = rf"[^\\{c}]*+(?:\\.[^\\{c}]*+)*+" if len(closer) == 1 else rf"(?:\\.|(?!{c})[^\\])*"
        hits = matches(text, rf"(?s)\\(?:.|\z)|{o}{inside}{c}")
        found.append(F.filter(hits, lambda m: ~F.startswith(m["text"], F.lit("\\"))))
    found.append(matches(text, SPEECH_LINE))
    return F.array_sort(F.concat(*found)) if found else F.array().cast(MATCH)


def _literal(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in s)


def in_dialogue(spans: Column, start: Column, end: Column) -> Column:
    """Whether a span lies inside of a quotation."""
    return F.coalesce(F.exists(spans, lambda s: within(F.struct(start.alias("start"), end.alias("end")), s)), F.lit(False))


def content_tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits, for scoring."""
    return texts(F.lower(text), r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*")


@F.pandas_udf(_list(kind=T.StringType(), text=T.StringType()))
def word_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Alignment of two texts for display: stretches that are the same, removed or added, by longest common subsequence."""
    import re

    parts = re.compile(r"\s+|\w+|[^\w\s]", re.UNICODE)

    def one(x: str | None, y: str | None) -> list[dict[str, str]]:
        a, b = parts.findall(x or ""), parts.findall(y or "")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        out: list[dict[str, str]] = []
        i = j = 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                kind, piece, i, j = "same", a[i], i + 1, j + 1
            elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
                kind, piece, i = "removed", a[i], i + 1
            else:
                kind, piece, j = "added", b[j], j + 1
            if out and out[-1]["kind"] == kind:
                out[-1]["text"] += piece
            else:
                out.append({"kind": kind, "text": piece})
        return out

    return pd.Series([one(x, y) for x, y in zip(before, after, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]))
def normalized_with_offsets(text: pd.Series) -> pd.DataFrame:
    """Composed text with white space collapsed, and for each of its characters the original stretch it stands for."""
    import unicodedata

    import regex

    clusters = regex.compile(r"\X")

    def one(t: str | None) -> tuple[str | None, list[int], list[int]]:
        if t is None:
            return None, [], []
        out, starts, ends = [], [], []
        for m in clusters.finditer(t):
            for c in unicodedata.normalize("NFC", m[0]):
                if c.isspace() or c == "﻿":
                    if out and out[-1] == " ":
                        ends[-1] = m.end()
                        continue
                    c = " "
                out.append(c)
                starts.append(m.start())
                ends.append(m.end())
        return "".join(out), starts, ends

    return pd.DataFrame([one(t) for t in text], columns=["text", "starts", "ends"])


def paragraphs_table(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(paragraphs(F.col(text_col))).alias("par", "p")).select(*keys, "par", "p.start", "p.end", "p.text")


def batches_by_budget(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items; one is closed before it would pass the budget, and once it reaches it."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > budget:
            yield start, i
            start, held = i, 0
        held += n
        if held >= budget:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
