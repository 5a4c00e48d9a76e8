"""The guard cascade as a whole, with its counters, and what stands around it."""

from pyspark.sql import functions as F

from folioscope.operators import evaluate, patterns
from folioscope.operators.lexicon import PACKS
from folioscope.operators.rules import Settings
from folioscope.plans import review
from folioscope.sources import manuscript

EN = PACKS["en"]
SCENE = "He saw teh old house. “I will recieve it,” she said. Marlow had two dogs. The the door stood open. My lorde was recieved late. He spoke slowly."
LONG = "The man went to the old town with his dog. " * 24


def test_guards_in_order(spark):
    scenes = spark.createDataFrame([("b", 0, SCENE), ("b", 1, LONG), ("c", 0, "Short teh text.")], "book string, scene int, text string")
    at = lambda word, text=SCENE: (text.index(word), text.index(word) + len(word))
    rows = [
        ("good", "b", 0, *at("teh"), "teh", "the", "grammar", "model"),
        ("stale", "b", 0, None, None, "gone", "here", "grammar", "model"),
        ("lost", "b", 9, 0, 2, "He", "She", "grammar", "model"),
        ("form", "b", 0, *at("lorde"), "lorde", "lord", "grammar", "model"),
        ("rule", "b", 0, *at("The the"), "The the", "The", "repetition", "model"),
        ("number", "b", 0, *at("two dogs"), "two dogs", "three dogs", "grammar", "model"),
        ("speech", "b", 0, *at("recieve"), "recieve", "receive", "grammar", "model"),
        ("voice", "b", 1, 4, 7, "man", "very tired and very old man", "grammar", "model"),
        ("broken", "b", 0, *at("recieved"), "recieved", "received", "grammar", "model"),
        ("unsure", "b", 0, *at("slowly"), "slowly", "softly and slowly", "grammar", "model"),
        ("refused", "b", 0, *at("spoke"), "spoke", "talked at length", "grammar", "model"),
        ("near", "c", 0, 6, 9, "teh", "the", "grammar", "model"),
        ("unasked", "c", 0, 10, 14, "text", "texts", "grammar", "model"),
    ]
    proposals = spark.createDataFrame(rows, "id string, book string, scene int, start int, end int, target string, replacement string, category string, source string")
    by_rule = spark.createDataFrame([("b", 0, "repetition.doubled-word", at("The the")[0], "The the", "The"), ("b", 0, "typography.quotes", at("teh")[0], "teh", "tEh")], "book string, scene int, rule string, start int, target string, replacement string")
    votes = [("good", 0, True, True), ("good", 1, True, True), ("broken", 0, None, None), ("unsure", 0, True, True), ("unsure", 1, None, None), ("refused", 0, False, False), ("near", 0, False, True), ("number", 0, True, True)]
    verdicts = spark.createDataFrame(votes, "id string, ord int, preserved boolean, necessary boolean")
    out = review.guard_run(proposals, scenes, ["book", "scene"], ["book"], EN, Settings(protected_forms=("lorde",)), by_rule, verdicts)
    got = {r.id: (r.status, r.guard, r.reason, r.unchecked) for r in out.collect()}
    assert got == {
        "good": ("offered", None, None, False),
        "stale": ("rejected", "semantic-trap", "target stale", False),
        "lost": ("rejected", "semantic-trap", "scene missing", False),
        "form": ("rejected", "semantic-trap", "protected-form", False),
        "rule": ("rejected", "rule-preferred", "rule-preferred", False),
        "number": ("rejected", "semantic-trap", "number-date-time-change", False),
        "speech": ("review-only", "semantic-trap", "dialogue-content-change", False),
        "voice": ("rejected", "voice", "sentence-length-outlier", False),
        "broken": ("review-only", None, None, True),
        "unsure": ("failed", None, None, True),
        "refused": ("rejected", None, None, False),
        "near": ("review-only", None, None, False),
        "unasked": ("rejected", None, None, False),
    }
    row = review.guard_counts(out).first().asDict()
    assert row == {"candidates": 13, "offered": 1, "review_only": 3, "rejected": 8, "failures": 2, "semantic_rejected": 4, "voice_rejected": 1, "rule_preferred": 1, "verifier_rejected": 2}
    assert review.guard_run(proposals.where("false"), scenes, ["book", "scene"], ["book"], EN, Settings(), by_rule, verdicts).count() == 0


def test_relevant_windows(spark):
    windows = spark.createDataFrame([("a", i, 100 * i, 100 * i + 90, "t") for i in range(3)] + [("b", 0, 0, 90, "t"), ("c", 0, 0, 90, "t")], "scene string, window int, start int, end int, text string")
    targets = spark.createDataFrame([("a", 110, 115), ("a", 85, 95), ("c", 90, 95)], "scene string, start int, end int")
    got = review.relevant(windows, targets, spark.createDataFrame([("b",), ("b",)], "scene string"), ["scene"])
    assert sorted((r.scene, r.window) for r in got.collect()) == [("a", 1), ("b", 0)]


def test_triggers_and_disagreements(spark):
    rows = [("He saw Ann.", "He saw Eva.", ["preserved"]), ("a b", "b a", ["preserved", "changed"]), ("same", "same", []), ("He said", "“He said", ["json-error"])]
    df = spark.createDataFrame(rows, "b string, a string, v array<string>").select(evaluate.risk_triggers(F.col("b"), F.col("a"), F.col("v")).alias("t"))
    assert [sorted(r.t) for r in df.collect()] == [["capitalized-word-change", "new-word"], ["split-verdicts", "word-order"], [], ["dialogue", "verification-failure"]]
    answers = spark.createDataFrame([("p", "yes"), ("p", "no"), ("q", "yes"), ("q", "yes"), ("r", "no")], "key string, verdict string")
    assert [tuple(r) for r in evaluate.disagreements(answers, ["key"], "verdict").collect()] == [("p", 2, 2)]
    sized = review.budgets(spark.createDataFrame([("x" * 400,), ("x" * 40_000,)], "text string"), EN).collect()
    assert 0 < sized[0].budget <= sized[1].budget


def test_precision_of_labels(spark):
    proposals = spark.createDataFrame([("1", ["p", "q"]), ("2", ["p"]), ("2", ["p"]), ("3", ["q", "q"]), ("4", ["z"])], "id string, sources array<string>")
    labels = spark.createDataFrame([("1", True), ("2", False), ("9", True)], "id string, useful boolean")
    assert tuple(review.labelled_precision(proposals, labels).first()) == (2, 1, 0.5)
    assert sorted(map(tuple, review.labelled_precision(proposals, labels, "sources").collect())) == [("p", 2, 1, 0.5), ("q", 1, 1, 1.0), ("z", 0, 0, None)]


def test_reasons_say_how_often(spark):
    scenes = spark.createDataFrame([("b", 0, "After a beat. " * 5)], "book string, scene int, text string")
    hits = patterns.scan_formulaic(scenes, EN, ["book"], ["book", "scene"]).collect()
    assert len(hits) == 5 and all("5 times, 3333.3 in 10,000 words" in h.reason for h in hits)


def test_nearest_workspace(spark, tmp_path):
    inner = tmp_path / "manuscript" / "chapters" / "notes"
    inner.mkdir(parents=True)
    (tmp_path / "manuscript" / "chapters" / "a.md").write_text("One.")
    (tmp_path / "manuscript" / "manuscript.yaml").write_text("schema_version: 1\nlanguage: en\nchapters:\n  - slug: a\n    title: A\n")
    for place in (tmp_path, tmp_path / "manuscript", inner):
        assert manuscript.workspace_of(spark, str(place)).endswith("/manuscript")
        assert [r.slug for r in manuscript.open_source(spark, str(place)).collect()] == ["a"]
    assert manuscript.open_source(spark, str(tmp_path / "manuscript" / "chapters" / "a.md")).first().slug == "a"
