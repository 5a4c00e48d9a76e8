import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators import defects, habits, harness, patterns
from folioscope.operators.lexicon import PACKS
from folioscope.operators.rules import Settings
from folioscope.plans import review
from folioscope.sources import manuscript, markup, records, settings
from folioscope.streaming import folds


def workspace(tmp_path, chapters, listed=None):
    (tmp_path / "chapters").mkdir()
    for slug, text in chapters.items():
        (tmp_path / "chapters" / f"{slug}.md").write_text(text)
    names = listed or list(chapters)
    (tmp_path / "manuscript.yaml").write_text("schema_version: 1\nlanguage: en\nchapters:\n" + "".join(f"  - slug: {s}\n    title: Title {s}\n" for s in names))
    return str(tmp_path)


def test_manuscript(spark, tmp_path):
    path = workspace(tmp_path, {"b": "Pre\n<!-- scene: x -->\nOne.\n", "a": "Two.", "z": "Extra."}, ["b", "a"])
    chapters, scenes, warnings = manuscript.read_manuscript(spark, path)
    assert [(r.chapter_ord, r.slug) for r in chapters.orderBy("chapter_ord").collect()] == [(0, "b"), (1, "a")]
    assert {(r.slug, r.scene_id, r.text) for r in scenes.collect()} == {("b", "s0", "Pre\n"), ("b", "x", "One.\n"), ("a", "s0", "Two.")}
    assert len(warnings) == 2
    assert manuscript.open_source(spark, path).count() == 2
    assert {r.slug for r in manuscript.open_source(spark, path + "/chapters").collect()} == {"a", "b"}  # the workspace around it
    assert {r.slug for r in manuscript.read_standalone(spark, path + "/chapters").collect()} == {"a", "b", "z"}
    assert manuscript.read_standalone(spark, path + "/chapters/a.md").first().text == "Two."


@pytest.mark.parametrize(
    ("chapters", "listed", "code"),
    [({"a": "x"}, ["a", "b"], "missing-chapter"), ({"a": "<!-- scene: x -->\na\n<!-- scene: x -->\nb"}, None, "duplicate-scene-id")],
)
def test_manuscript_errors(spark, tmp_path, chapters, listed, code):
    with pytest.raises(manuscript.SourceError) as e:
        manuscript.read_manuscript(spark, workspace(tmp_path, chapters, listed))
    assert e.value.code == code


def test_manifest_errors(spark, tmp_path):
    with pytest.raises(manuscript.SourceError) as e:
        manuscript.read_manuscript(spark, str(tmp_path))
    assert e.value.code == "missing-manifest"
    (tmp_path / "manuscript.yaml").write_text("language: en\n")
    with pytest.raises(manuscript.SourceError) as e:
        manuscript.read_manuscript(spark, str(tmp_path))
    assert e.value.code == "invalid-manifest"


def test_runs_and_findings(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([{"id": "a", "target": "x"}, {"id": "b", "target": "y"}], records.PROPOSAL)
    records.write_run(rows, path, "r1")
    records.write_run(rows.where("id = 'a'"), path, "r2")
    assert records.latest_run(spark, path) == "r2" and records.read_run(spark, path, "r1").count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        records.write_run(rows, path, "r1")
    (tmp_path / "bad.jsonl").write_text('{"id":"a"}\n{oops\n')
    assert records.read_lines(spark, str(tmp_path / "bad.jsonl"), records.STATUS, strict=False).where("_corrupt_record is not null").cache().count() == 1
    hits = spark.createDataFrame([(0, 1, "a b a", 4, 5, "a", "sig", "P One")], "ch int, sc int, text string, start int, end int, quote string, id string, principle string")
    found = records.to_findings(hits, "ch", "sc", "tool", "r")
    good, bad = records.valid_findings(found)
    assert good.count() == 1 and bad.count() == 0
    broken = found.withColumn("evidence_hash", F.lit("sha256:0"))
    assert records.valid_findings(broken)[0].count() == 0
    scenes = spark.createDataFrame([("ch01/s02", "a b a")], "scene_id string, text string")
    assert [(r.state, r.start) for r in records.route(found, scenes).collect()] == [("applicable", 0)]
    assert records.report(spark.createDataFrame([("mechanical", "grammar", "c", "s", "1", "x", "y")], "impact string, category string, chapter string, scene string, id string, target string, replacement string")).count() == 3


def test_markup(spark):
    html = "<html><script>var a='<p>'</script><p>One <b>two</b></p><!-- no --></html>"
    assert spark.range(1).select(markup.plain(F.lit(html))).first()[0] == "One two"
    wiki = "'''Bold''' {{t|{{u}}}}[[A|label]]<ref>x</ref> text\n== Head ==\nBody [[Plain]]."
    assert spark.range(1).select(markup.wiki_text(F.lit(wiki))).first()[0] == "Bold label text\n== Head ==\nBody Plain."
    got = spark.range(1).select(markup.sections(F.lit("Intro\n== Head ==\nBody"))).first()[0]
    assert [(s.title, s.body) for s in got] == [("", "Intro"), ("Head", "Body")]
    table = spark.createDataFrame([("| id | name |\n|---|---|\n| p.a | A |\n| p.b | B |",)], "text string")
    assert [r.principle for r in markup.principles(table, 2).collect()] == ["p.a", "p.b"]
    with pytest.raises(ValueError, match="bad catalog"):
        markup.principles(table, 3)


def test_settings():
    got, origin = settings.overlay([("default", {"a": 1, "b": {"c": 1, "d": 2}, "preserve": ["x"]}), ("workspace", {"b": {"c": 3}, "preserve": ["y", "x"]}), ("call", {"a": None})])
    assert got == {"a": 1, "b": {"c": 3, "d": 2}, "preserve": ["x", "y"]}
    assert origin["b.c"] == "workspace" and origin["a"] == "default" and origin["preserve"] == "default+workspace"
    assert settings.from_environment({"FOLIOSCOPE_A__B": "1", "X": "2"}) == {"a": {"b": "1"}}


def scenes(spark, *texts):
    return spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book string, scene int, text string")


def test_mechanical_run(spark):
    s = scenes(spark, "Mum came came late. “Go on.”", "Nothing here.")
    titles = spark.createDataFrame([("b", -1, "The the title")], "book string, scene int, text string")
    found = review.mechanical_run(s, ["book", "scene"], PACKS["en"], Settings(), titles=titles)
    row = found.collect()
    assert [(p.scene, p.target, p.replacement) for p in row] == [(0, "came came", "came")]
    rejected = found.select("proposal_id", "target_hash")
    assert review.mechanical_run(s, ["book", "scene"], PACKS["en"], Settings(), rejected=rejected).count() == 0


def test_formulaic(spark):
    s = scenes(spark, "Here's the thing. “Let me be clear,” she said.", "A vibrant tapestry, meticulous work.", "A vibrant day.")
    got = patterns.scan_formulaic(s, PACKS["en"], ["book"], ["book", "scene"]).collect()
    assert sorted((h.scene, h.id, h.quote) for h in got) == [(0, "formulaic.throat-clearing", "Here's the thing"), (1, "formulaic.ai-vocabulary", "meticulous"), (1, "formulaic.ai-vocabulary", "tapestry"), (1, "formulaic.ai-vocabulary", "vibrant")]
    beats = scenes(spark, "After a beat. " * 5)
    assert {h.book_n for h in patterns.scan_formulaic(beats, PACKS["en"], ["book"], ["book", "scene"]).collect()} == {5}
    assert patterns.scan_formulaic(scenes(spark, "After a beat. " * 4), PACKS["en"], ["book"], ["book", "scene"]).count() == 0


@pytest.mark.parametrize(
    ("guide", "text", "quote"),
    [
        ("en-clarity", "He was late due to the fact that it rained.", "due to the fact that"),
        ("en-prose-style", "Time stood still.", "Time stood still"),
        ("en-fiction-editing", "He replied with surprise.", "replied with surprise"),
        ("en-fiction-editing", "She said angrily. He said softly.", "said angrily"),
    ],
)
def test_guides(spark, guide, text, quote):
    got = review.guide_run(scenes(spark, text), ["book", "scene"], patterns.GUIDES[guide], PACKS["en"]).collect()
    assert [h.quote for h in got] == [quote]


def test_russian_guides(spark):
    s = scenes(spark, "Они осуществляли проверку. «Имеет место ошибка», — сказал он. Как известно, шёл дождь.")
    assert [h.quote for h in patterns.check_guide(s, patterns.GUIDES["nora-gal"], PACKS["ru"], ["scene"]).collect()] == ["осуществляли проверку"]
    assert [h.quote for h in patterns.check_guide(s, patterns.GUIDES["infostyle"], PACKS["ru"], ["scene"]).collect()] == ["Как известно"]
    assert patterns.check_guide(s, patterns.GUIDES["infostyle"], PACKS["en"], ["scene"]).count() == 0


def test_habits(spark):
    row = spark.createDataFrame([([], "The “the way…” frame recurs"), (["at last"], "The “x y z” frame")], "e array<string>, s string")
    assert [r[0] for r in row.select(habits.phrases(F.col("e"), F.col("s"))).collect()] == [["the way"], ["at last"]]
    uses = spark.createDataFrame([("h", i, w, 5) for i, w in enumerate(["a", "b", "b", "c", "d"])], "habit string, ord int, inserted string, total int")
    assert [r.ord for r in review.thin_habits(uses).orderBy("ord").collect()] == [0, 1, 3]
    s = scenes(spark, "He did it the way men do. Then not.", "Again the way it was.")
    named = spark.createDataFrame([("h", ["the way"])], "habit string, phrases array<string>")
    assert habits.uses(s, named, PACKS["en"], ["scene"]).count() == 2


def test_wrong_language(spark):
    book = "The old man walked along the river and watched the water move under the bridge in the evening light. " * 3
    profile, prefixes = patterns.language_profile(scenes(spark, book), ["book"], PACKS["en"].stopwords)
    values = spark.createDataFrame([("b", 0, "The old man watched the river move in the evening light"), ("b", 1, "Ceci est une phrase française beaucoup trop différente pour passer ici"), ("b", 2, "Это предложение написано по-русски"), ("b", 3, "short id")], "book string, value_id int, value string")
    assert sorted(r.value_id for r in patterns.wrong_language(values, profile, prefixes, ["book"], PACKS["en"].stopwords).collect()) == [1, 2]


def test_windows(spark):
    s = scenes(spark, "aaaa\n\nbbbb\nbb\n\ncc\n\n\ndddddddddd")
    got = review.edit_windows(s, ["book", "scene"], 8).orderBy("window").collect()
    assert [(w.text, w.before, w.after) for w in got] == [("aaaa", "", "bbbb\nbb\n\ncc\n\n\ndddddddddd"), ("bbbb\nbb", "aaaa", "cc\n\n\ndddddddddd"), ("cc", "bbbb\nbb", "dddddddddd"), ("dddddddddd", "cc", "")]


def test_candidates_and_votes(spark):
    rows = spark.createDataFrame([("1", "p", "one", "clear", "one two two"), ("2", "p", "two", "clear", "one two two"), ("3", "q", "one", "clear", "one two two"), ("4", "p", "one", "maybe so", "one two two")], "id string, principle string, quote string, reason string, text string")
    good = review.candidate_findings(rows, ["p"])
    assert [(r.id, r.start, r.end) for r in good.collect()] == [("1", 0, 3)]
    votes = spark.createDataFrame([("1", True), ("1", False)], "id string, yes boolean")
    assert review.confirmed(good, votes).count() == 0
    assert review.confirmed(good, votes.where("yes")).count() == 1


def test_stream(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    lines = [[("a", 1, "accept", "x"), ("b", 2, "accept", "x")], [("a", 3, "withdraw", None), ("b", 4, "accept", "y")], [("a", 5, "accept", "z")]]
    for i, part in enumerate(lines):
        (path / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("id", "line", "event", "payload"), r, strict=True))) for r in part))
        os.utime(path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of their times
    q = folds.acceptances(folds.read_log(spark, str(path))).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination(90)
    last = {}
    for r in sorted(spark.table("folded").collect(), key=lambda r: r.line):
        last[r.id] = (r.active, r.payload, r.conflict)
    assert last == {"a": (True, "z", False), "b": (True, "x", True)}


def test_habit_details(spark):
    s = scenes(spark, "She squared the cards. She squared the deck. “Squared,” he said.")
    named = spark.createDataFrame([("h", ["squared", "squared the"])], "habit string, phrases array<string>")
    assert [(r.habit, r.n) for r in habits.counts(s, named).collect()] == [("h", 3)]
    assert [(u.start, u.spoken) for u in habits.uses(s, named, PACKS["en"], ["scene"]).orderBy("start").collect()] == [(0, False), (23, False), (45, True)]
    many = spark.createDataFrame([("a", ["the way"]), ("b", ["the way of"]), ("c", ["other"])], "habit string, phrases array<string>")
    assert sorted((r.habit, sorted(r.phrases)) for r in habits.merged(many).collect()) == [("a", ["the way", "the way of"]), ("c", ["other"])]
    rows = [("She squared the cards, then left.", "She stacked the cards, then left.", True), ("She squared the cards, then left.", "She squared the cards, then ran.", False), ("One two three squared it.", "Four two three squared it.", False)]
    df = spark.createDataFrame(rows, "s string, r string, w boolean")
    assert all(x.w == x.g for x in df.select("w", habits.inside(F.col("s"), F.col("r"), F.array(F.lit("squared"))).alias("g")).collect())


def test_mutations(spark):
    s = scenes(spark, "The window looked bright and people were talking, slowly. " * 3)
    got = defects.inject(s, "book", ["book", "scene"], PACKS["en"], ("typo", "doubled-word", "punctuation"), "seed").collect()
    text = s.first().text
    assert {m.kind for m in got} == {"typo", "doubled-word", "punctuation"}
    out = text
    for m in sorted(got, key=lambda m: -m.start):
        assert text[m.start : m.end] == m.original
        out = out[: m.start] + m.mutated + out[m.end :]
    for m in got:
        assert out[m.at : m.at + len(m.mutated)] == m.mutated
    assert sorted(map(tuple, got)) == sorted(map(tuple, defects.inject(s, "book", ["book", "scene"], PACKS["en"], ("typo", "doubled-word", "punctuation"), "seed").collect()))


def test_guide_score(spark):
    hits = spark.createDataFrame([("s1", 0, 9, "p"), ("s1", 20, 29, "p"), ("s2", 0, 5, "p"), ("s3", 0, 5, "q")], "scene string, start int, end int, principle string")
    defects = spark.createDataFrame([("s1", 5, 12, "p"), ("s3", 3, 9, "p"), ("s4", 0, 5, "p")], "scene string, start int, end int, principle string")
    keep = spark.createDataFrame([("s2",)], "scene string")
    row = harness.guide_score(hits, defects, keep).first()
    assert (row.tp, row.near, row.fp_on_keep, row.unlabeled, round(row.recall, 3)) == (1, 1, 1, 1, 0.333)


def test_review_view(spark):
    shape = "id string, target string"
    latest, history = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], shape), spark.createDataFrame([("2", "old"), ("4", "d")], shape)
    results = spark.createDataFrame([("2", "applied"), ("4", "conflict")], "id string, status string")
    places = spark.createDataFrame([("1", True), ("3", True)], "id string, found boolean")
    view = harness.review_view(latest, history, results, spark.createDataFrame([("3",)], "id string"), places)
    assert {(r.id, r.target, r.status) for r in view.collect()} == {("1", "a", "pending"), ("2", "old", "accepted"), ("3", "c", "rejected"), ("4", "d", "conflict")}


def test_habits_are_thinned_in_order(spark):
    rows = [("h", 0, "", 9), ("h", 1, "", 9), ("h", 2, "set straight", 9), ("g", 3, "set straight", 3), ("g", 4, "made flush", 3), ("g", 5, "cut", 3), ("g", 6, "other", 3), ("h", 7, "fremd", 9), ("h", 8, "made flush", 9), ("h", 9, None, 9), ("f", 10, "used", 9)]
    uses = spark.createDataFrame([(*r, r[2] == "fremd") for r in rows], "habit string, ord int, inserted string, total int, wrong_language boolean")
    kept = review.thin_habits(uses, reused=("used",)).collect()
    # deletions don't count as wording; a wording holds for all habits; two of three uses of g are the most
    assert sorted(r.ord for r in kept) == [0, 1, 2, 4, 5, 9]
    assert review.thin_habits(uses.where("false")).count() == 0


def test_frames_worth_a_habit(spark):
    kind, many = "repetition.sentence-frame", ["a", "b", "c"]
    rows = [
        ("x", "1", kind, "medium", "… and did not …", 9.0, many), ("x", "2", kind, "medium", "and did", 8.0, many), ("x", "3", kind, "high", "so was", 20.0, many),
        ("x", "4", "repetition.tic", "medium", "chair", 20.0, many), ("x", "5", kind, "medium", "the … was", 20.0, many), ("x", "6", kind, "medium", "which was", 7.0, ["a", "b", "a", None]),
        ("x", "7", kind, "medium", "Which was how", 6.0, many), ("x", "8", kind, "medium", "or else", 5.0, many), ("x", "9", kind, "medium", "if not", 4.0, many), ("x", "10", kind, "medium", "as for", 3.0, many), ("x", "11", kind, "medium", "but then", 2.0, many),
    ]
    findings = spark.createDataFrame(rows, "book_id string, id string, category string, severity string, key string, metric double, chapters array<string>")
    assert sorted(r.frame for r in review.frames(findings).collect()) == ["and did not", "if not", "or else", "which was how"]
    named = spark.createDataFrame([("x", "Which was"), ("y", "or else")], "book_id string, phrase string")
    assert sorted(r.frame for r in review.frames(findings, named).collect()) == ["and did not", "as for", "if not", "or else"]


def test_long_words_and_clauses(spark):
    from pyspark.sql import functions as F

    from folioscope.functions.matching import run_before
    from folioscope.operators.habits import inside
    from folioscope.operators.rules import widen

    word = "é" * 65 + "x" * 200
    row = spark.createDataFrame([(f"a {word} b",)], "text string").select(widen(F.col("text"), F.lit(260), F.lit(262), F.lit("yy")).alias("w"), run_before(F.col("text"), F.lit(1), "a").alias("r")).first()
    assert (row.w.start, row.w.end, row.w.target) == (2, 267, word) and row.r == "a"
    tail = "word " * 90 + "end"
    made = spark.createDataFrame([(f"He squared his papers {tail}", f"He squared his papers {tail}".replace("end", "over"))], "a string, b string")
    assert made.select(inside(F.col("a"), F.col("b"), F.array(F.lit("squared"))).alias("x")).first().x
    stop = spark.createDataFrame([("He squared, and went", "He squared, and ran")], "a string, b string")
    assert not stop.select(inside(F.col("a"), F.col("b"), F.array(F.lit("squared"))).alias("x")).first().x
