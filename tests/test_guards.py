import pytest
from pyspark.sql import functions as F

from folioscope.operators import guards
from folioscope.operators.lexicon import PACKS


def trap(spark, before, after, lang="en", category="grammar", dialogue=False, model=True, prefix=None, names=None, review=False):
    row = spark.createDataFrame([(before, after, category, dialogue, model, prefix, names)], "b string, a string, c string, d boolean, m boolean, p string, n array<string>")
    e = guards.Edit(F.col("b"), F.col("a"), F.col("c"), F.col("d"), F.col("m"), F.col("p"), F.col("n"))
    return row.select(guards.semantic_trap(e, PACKS[lang], review)).first()[0]


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [
        ("wait… now", "wait now", "ellipsis-change"),
        ("a", "a ", "trailing-space-only"),
        ("he came and left", "he came, and left", "coordinate-comma-insertion"),
        ("so he left", "so, he left", "unsupported-comma-change"),
        ("one; two", "one: two", "punctuation-style-only"),
        ("at 10:14 sharp", "at 10:15 sharp", "number-date-time-change"),
        ("two dogs", "three dogs", "number-date-time-change"),
        ("he didn't go", "he did go", "negation-change"),
        ("he never slept", "he slept", "negation-change"),
        ("saw Mark there", "saw Mary there", "proper-name-change"),
        ("saw Mark and Mark", "saw Mark", "proper-name-change"),
        ("he might come", "he will come", "certainty-change"),
        ("it seemed odd", "it was odd", "certainty-change"),
        ("went upstairs", "went downstairs", "location-change"),
        ("his coat", "her coat", "ownership-change"),
        ("he hoped so", "he thought so", "intention-change"),
        ("in the morning", "in the night", "chronology-change"),
        ("the teh cat", "the cat", None),
        ("recieve it", "receive it", None),
    ],
)
def test_traps(spark, before, after, want):
    assert trap(spark, before, after) == want


def test_traps_by_context(spark):
    assert trap(spark, "we eats", "we eat", dialogue=True) == "dialogue-content-change"
    assert trap(spark, "we eats", "we eat", dialogue=True, category="dialogue-mechanics") == "dialogue-mechanics-content-change"
    assert trap(spark, "Rain fell", "Snow fell", prefix="It was late. ", names=[]) is None  # opens a sentence, no name of the book
    assert trap(spark, "Rain fell", "Snow fell", prefix="It was late. ", names=["Rain"]) == "proper-name-change"
    assert trap(spark, "все", "всё", "ru") == "yo-normalization"
    assert trap(spark, "он встал и ушёл", "он встав ушёл", "ru") == "sequence-to-gerund-change"
    assert trap(spark, "Иваныч Иваныч пришёл", "Иваныч пришёл", "ru", model=False) is None


def test_typos(spark):
    rows = spark.createDataFrame([("goign home", "going home", True), ("В кратце", "Вкратце", True), ("a cat", "a dog", False), ("a, b", "a b", False)], "b string, a string, w boolean")
    got = rows.select("w", guards.typo_shaped(F.col("b"), F.col("a")).alias("g")).collect()
    assert all(r.w == r.g for r in got)
    row = spark.createDataFrame([("не плохо", "неплохо", "grammar", False, True)], "b string, a string, c string, d boolean, m boolean")
    e = guards.Edit(*(F.col(c) for c in "bacdm"))
    assert row.select(guards.typo_reviewable(guards.semantic_trap(e, PACKS["ru"]), e, PACKS["ru"])).first()[0]


def test_classify(spark):
    rows = spark.createDataFrame([("a  b", "a b", "mechanical"), ("colour", "color", "mechanical"), ("a, b", "a b", "prose"), ("cat", "dog", "prose")], "t string, r string, w string")
    assert all(r.w == r.g for r in rows.select("w", guards.classify(F.col("t"), F.col("r"), PACKS["en"]).alias("g")).collect())


def test_voice(spark):
    text = "The man went to the old town with his dog. " * 24
    scenes = spark.createDataFrame([("b", text)], "book string, text string")
    limits = guards.voice_limits(scenes, PACKS["en"], ["book"])
    row = limits.first()
    assert (row.n, row.low, row.high, row.marks) == (24, 9, 11, 1)
    met = scenes.join(limits, "book")

    def reason(start, end, replacement, category="grammar", **kw):
        made = guards.voice_reason(F.col("text"), F.lit(start), F.lit(end), F.lit(replacement), F.lit(category), PACKS["en"], F.struct("low", "high", "marks"), **kw)
        return met.select(made).first()[0]

    assert reason(4, 7, "woman") is None
    assert reason(4, 7, "very tired and very old man") == "sentence-length-outlier"
    assert reason(4, 7, "man; yes;") == "punctuation-profile-outlier"
    few = guards.voice_limits(spark.createDataFrame([("b", "Short one.")], "book string, text string"), PACKS["en"], ["book"]).first()
    assert few.low is None
