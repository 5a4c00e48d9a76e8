import hashlib
import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import matching, numbers
from folioscope.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_matches_count_code_points(spark):
    got = one(spark, matching.matches(F.col("t"), r"(\p{L})(\d)?", 2), t="😀a1 b")
    assert [(m.start, m.end, m.text, m.groups) for m in got] == [(1, 3, "a1", ["a", "1"]), (4, 5, "b", ["b", ""])]
    assert one(spark, matching.matches(F.lit(None).cast("string"), "a")) == []


@pytest.mark.parametrize(("text", "literal", "want"), [("aaaa", "aa", [0, 2]), ("a.b.c", ".", [1, 3]), ("x", "", []), ("", "x", []), (r"\Ea\E", r"\E", [0, 3])])
def test_occurrences(spark, text, literal, want):
    assert one(spark, matching.occurrences(F.col("t"), F.col("l")), t=text, l=literal) == want


def test_occurrence_before(spark):
    assert one(spark, matching.occurrence_before(F.lit("aaaa a"), F.lit("aa"), F.lit(5))) == 2


def test_spans(spark):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    assert one(spark, matching.overlaps(span(0, 2), span(1, 3)))
    assert not one(spark, matching.overlaps(span(0, 2), span(2, 3)))
    assert one(spark, matching.touches(span(1, 1), span(0, 2)))
    assert not one(spark, matching.touches(span(0, 0), span(0, 2)))
    assert one(spark, matching.within(span(1, 2), span(0, 2)))


def test_normalize(spark):
    assert one(spark, X.normalize_text(F.lit("﻿é  \r\n\r\n\r\n\r\nb\t"))) == "é\n\nb\n"
    assert one(spark, X.normalize_text(F.lit(""))) == "\n"
    assert one(spark, X.normalize_quote(F.lit(" a \n b "))) == "a b"
    assert one(spark, X.sha256(F.lit("a"))) == "sha256:" + hashlib.sha256(b"a").hexdigest()


@pytest.mark.parametrize(("a", "b", "want"), [("Управление", "Управления", True), ("Кольцевая", "кольца", False), ("Mara", "Maro", True), ("a", "b", False), ("Fowler", "Fowlers", True)])
def test_same_stem(spark, a, b, want):
    assert one(spark, X.same_stem(F.lit(a), F.lit(b))) is want


def test_changed_span(spark):
    cases = [("said said", "said"), ("abc", "abc"), ("", "x"), ("x", ""), ("aXb", "aYb"), ("aaa", "aa"), ("abcabc", "abc")]
    rows = spark.createDataFrame(cases, "a string, b string").select("a", "b", X.changed_span(F.col("a"), F.lit(10), F.col("b")).alias("c")).collect()
    for r in rows:
        p = 0
        while p < min(len(r.a), len(r.b)) and r.a[p] == r.b[p]:
            p += 1
        q = 0
        while q < min(len(r.a), len(r.b)) - p and r.a[-1 - q] == r.b[-1 - q]:
            q += 1
        assert (r.c.start, r.c.end) == (10 + p, 10 + len(r.a) - q), r


def test_osa(spark):
    pairs = [("goign", "going", 1), ("ca", "abc", 3), ("", "ab", 2), ("same", "same", 0)]
    got = spark.createDataFrame(pairs, "a string, b string, n int").select("n", X.osa_distance("a", "b").alias("d")).collect()
    assert all(r.n == r.d for r in got)


def test_ids_and_fnv(spark):
    want = hashlib.sha256(json.dumps({"a": 1, "b": "x"}, separators=(",", ":")).encode()).hexdigest()[:16]
    assert one(spark, X.stable_id(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b")))) == want
    h = 2166136261
    for c in b"seed:work":
        h = (h ^ c) * 16777619 % 2**32
    assert one(spark, X.fnv1a(F.lit("seed:work"))) == h


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4), st.text("xyz", max_size=3)), max_size=5), st.text("ab é😀", min_size=40, max_size=60))
def test_splice(spark, edits, text):
    kept, last = [], 0
    for s, n, r in sorted(edits):
        if s >= last:
            kept.append((s, s + n, r))
            last = s + n
    want = text
    for s, e, r in reversed(kept):
        want = want[:s] + r + want[e:]
    row = spark.createDataFrame([(text, kept)], "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert row.select(X.splice(F.col("t"), F.col("e"))).first()[0] == want


def test_small_ones(spark):
    assert one(spark, X.like_case(F.lit("Color"), F.lit("colour"))) == "Colour"
    assert one(spark, X.line_of(F.lit("a\nb\nc"), F.lit(4))) == 3
    assert one(spark, X.strip_quotes(F.lit("«a b»"))) == "a b"
    assert one(spark, X.fenced(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert one(spark, X.slug(F.lit("Ünder The  Hill!"))) == "ünder-the-hill"
    assert one(spark, X.inserted_key(F.array(F.lit("a")), F.array(F.lit("c"), F.lit("a"), F.lit("b")))) == "b c"
    assert one(spark, X.is_subsequence(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert not one(spark, X.is_subsequence(F.array(F.lit("c"), F.lit("a")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert unicodedata.normalize("NFC", "é") == one(spark, X.nfc(F.lit("é")))


def test_numbers(spark):
    v = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "v double")
    got = v.agg(numbers.midpoint_median("v").alias("m"), numbers.floor_quantile("v", 0.75).alias("q"), numbers.low_median("v").alias("l")).first()
    assert (got.m, got.q, got.l) == (2.5, 3.0, 2.0)
    q = numbers.floor_quantiles(v.union(v.where("v = 2")).withColumn("g", F.lit(1)), ["g"], "v", {"a": 0.0, "b": 0.5, "c": 0.75, "d": 1.0}).first()
    assert (q.a, q.b, q.c, q.d) == (1.0, 2.0, 3.0, 10.0)
    assert one(spark, numbers.token_budget(F.lit(100000), 4.0)) == 31250
    assert one(spark, numbers.token_budget(F.lit(10), 4.0)) == 2048
    calls = spark.createDataFrame([(1.0, True), (None, False)], "cost double, billed boolean")
    assert calls.agg(numbers.total_or_null(F.col("cost"), F.col("billed"))).first()[0] == 1.0
    assert calls.agg(numbers.total_or_null(F.col("cost"), F.lit(True))).first()[0] is None
