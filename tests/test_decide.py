import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import decide, evaluate, events, intervals, snapshot


@pytest.mark.parametrize(
    ("scene", "target", "more", "want"),
    [
        ("We sailed   slowly north.", "sailed slowly", {}, ("ok", 3, 18, False)),
        ("one go, two go", "go", {"occurrence": 1}, ("ok", 12, 14, False)),
        ("one go, two go", "go", {"occurrence": 4}, ("ambiguous", None, None, None)),
        ("one go, two go", "go", {"before": "two "}, ("ok", 12, 14, False)),
        ("text", "missing", {}, ("stale", None, None, None)),
        ("gone", "go", {}, ("stale", None, None, None)),
        ("a go b", "go", {"before": "other"}, ("ok", 2, 4, True)),
    ],
)
def test_find_target(scene, target, more, want):
    assert decide.find_target(scene, target, **more) == want


def test_plan(spark):
    text = "Ten lanterns blinked twice. One more there."
    chapters = spark.createDataFrame([("b", "one", text), ("b", "two", "Other.")], "book string, slug string, text string")
    scenes = spark.createDataFrame([("b", "one", "s0", 0, text), ("b", "two", "s0", 0, "Other.")], "book string, slug string, scene_id string, start int, text string")
    rows = [("b", "one", "s0", "1", "lanterns blinked", "lamps blinked", None, None, None), ("b", "one", "s0", "2", "blinked twice", "blinked two times", None, None, None), ("b", "one", "s0", "3", "more", "more thing", None, None, None), ("b", "one", "s9", "4", "x", "y", None, None, None), ("b", "nine", "s0", "5", "x", "y", None, None, None), ("b", "two", "s0", "6", "Other", "Another", "before", None, None), ("b", "two", "s0", "7", "gone", "y", None, None, None)]
    accepted = spark.createDataFrame(rows, "book string, slug string, scene_id string, id string, target string, replacement string, before string, after string, occurrence int")
    results, outputs = decide.plan(chapters, scenes, accepted, ["book", "slug"])
    assert {r.id: (r.status, r.detail) for r in results.collect()} == {
        "1": ("applied", None), "2": ("conflict", "meets an edit that was accepted before it"), "3": ("applied", None), "4": ("stale", "scene missing"), "5": ("stale", "chapter missing"), "6": ("stale", "context changed since the proposal"), "7": ("stale", "target gone"),
    }
    assert {r.slug: r.text for r in outputs.collect()} == {"one": "Ten lamps blinked twice. One more thing there.", "two": "Other."}


def test_merge_passes(spark):
    scene = "saw teh dog and the the cat"
    scenes = spark.createDataFrame([(0, scene)], "k int, text string")
    edits = [("a", "standard", 4, 7, "the"), ("b", "diagnostic", 0, 11, "saw the dog"), ("c", "standard", 16, 23, "the"), ("d", "diagnostic", 16, 23, "a"), ("e", "standard", 24, 27, "dog")]
    rows = [(0, i, p, "grammar", s, e, scene[s:e], r) for i, p, s, e, r in edits]
    placed = lambda order: spark.createDataFrame([rows[i] for i in order], "k int, id string, pass string, category string, start int, end int, target string, replacement string")
    seen = set()
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], random.Random(1).sample(range(5), 5)):
        kept, conflicts = decide.merge_passes(placed(order), scenes, ["k"])
        seen.add(tuple(sorted((r.id, tuple(r.passes), tuple(r.merged_ids)) for r in kept.collect())))
        assert conflicts.count() == 1
    assert seen == {(("a", ("diagnostic", "standard"), ("a", "b")), ("e", ("standard",), ("e",)))}


def test_answers(spark):
    answer = '```json\n{"edits":[{"target":"teh","replacement":"the","category":"grammar","reason":"x"},{"target":"zzz","replacement":"y","category":"g","reason":"x"},{"target":"cat","replacement":"cat","category":"g","reason":"x"}]}\n```'
    good, bad = decide.answers_to_edits(spark.createDataFrame([(0, "teh cat teh", answer)], "k int, window string, answer string"), ["k"])
    assert [r.target for r in good.collect()] == ["teh"]
    assert {r.why for r in bad.collect()} == {"target-not-verbatim-in-window", "no-op"}
    scenes = spark.createDataFrame([(0, "teh cat teh")], "k int, text string")
    assert decide.unambiguous(good, scenes, ["k"]).count() == 0  # two places, one edit
    assert [r.start for r in decide.unambiguous(good.union(good), scenes, ["k"]).orderBy("start").collect()] == [0, 8]


def accepted_by_hand(spans):
    out, last = [], None
    for s, e in sorted(spans):
        ok = last is None or s >= last
        out.append(ok)
        last = e if ok else last
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=12))
def test_greedy(spark, spans):
    spans = sorted((s, s + n) for s, n in spans)
    got = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int>>").select(intervals.greedy(F.col("s"))).first()[0]
    assert got == accepted_by_hand(spans)


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (1, 12, 15)], "k int, start int, end int")
    assert intervals.collapsed_count(spans, ["k"]).first().n == 1
    assert sum(r.accepted for r in intervals.schedule(spans.withColumn("id", F.col("start")), ["k"], "id").collect()) == 2
    rows = spark.createDataFrame([(0, "A", 0, 20), (1, "A", 0, 31), (2, "B", 0, 31), (3, "A", 40, 50)], "ord int, p string, start int, end int")
    assert sorted(r.ord for r in intervals.first_kept(rows, ["p"], "ord").collect()) == [0, 2, 3]
    a = spark.createDataFrame([(i, i * 7, i * 7 + 9) for i in range(60)], "k int, start int, end int").withColumn("k", F.lit(1))
    plain = intervals.span_join(a, a, ["k"]).count()
    assert intervals.span_join(a, a, ["k"], width=20).count() == plain
    assert intervals.span_join(a, a.where("start < 50"), ["k"], "left_anti").count() == intervals.span_join(a, a.where("start < 50"), ["k"], "left_anti", width=20).count() == 60 - 9


def test_events(spark):
    log = spark.createDataFrame([("a", 1, "accept", "x"), ("a", 2, "withdraw", None), ("a", 3, "accept", "y"), ("b", 4, "accept", "x"), ("b", 5, "accept", "z"), ("c", 6, "accept", "x"), ("c", 7, "withdraw", None)], "id string, line long, event string, payload string")
    got = {r.id: (r.payload, r.conflict) for r in events.active_acceptances(log, "id", "line").collect()}
    assert got == {"a": ("y", False), "b": ("x", True)}
    assert {r.id: r.payload for r in events.first_wins(log, ["id"], ["line"]).collect()}["a"] == "x"
    at = "2026-01-0"
    rows = [("w", "me", at + "1", at + "5", ["edit"], [], None, None), ("v", "me", at + "1", at + "5", ["edit"], [], None, "other workspace"), ("w", "me", at + "1", "2026-01-09", ["edit"], [], None, "longer than seven days"), ("w", "me", at + "4", at + "5", ["edit"], [], None, "not yet valid"), ("w", "me", at + "1", at + "2", ["edit"], [], None, "expired"), ("w", "me", at + "1", at + "5", ["edit"], [], at + "2", "revoked"), ("w", "me", at + "1", at + "5", ["edit"], ["edit"], None, "denied"), ("w", "me", at + "1", at + "5", ["x"], None, None, "not allowed"), (None, "me", at + "1", at + "5", ["x"], None, None, "incomplete")]
    d = spark.createDataFrame(rows, "workspace string, granted_by string, granted_at string, expires_at string, allow array<string>, deny array<string>, revoked_at string, want string")
    why = events.delegation_refusal(F.struct(*d.columns), F.lit("w"), F.lit("edit"), F.lit("2026-01-03").cast("timestamp"))
    assert all(r.want == r.got for r in d.select("want", why.alias("got")).collect())


def test_snapshot(spark):
    a, b = (spark.createDataFrame(r, "id int, evidence string") for r in ([(1, "x"), (2, "x"), (3, "x")], [(2, "x"), (3, "y"), (4, "z")]))
    changes = snapshot.run_diff(a, b)
    assert {(r.id, r.state) for r in changes.collect()} == {(1, "resolved"), (2, "unchanged"), (3, "updated"), (4, "new")}
    assert snapshot.with_stale(changes, b.where("id = 2")).count() == 5
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, hash string")
    assert snapshot.same_files(f, f).first().same and not snapshot.same_files(f, f.where("file = 'a'")).first().same


def test_outcomes(spark):
    scene = "He saw the the dog."
    mutation = dict(start=7, end=14, original="the", mutated="the the", alternatives=["a"])
    cases = [((7, 14, "the"), None, "exact"), ((7, 14, "a"), None, "alternative"), ((7, 14, "this the"), None, "incorrect"), ((7, 14, "the"), "harmful", "harmful"), ((0, 2, "She"), None, None), ((7, 14, "the the"), None, None)]
    rows = [(scene, e, mutation, j, w) for e, j, w in cases]
    df = spark.createDataFrame(rows, "s string, e struct<start:int,end:int,replacement:string>, m struct<start:int,end:int,original:string,mutated:string,alternatives:array<string>>, j string, w string")
    got = df.select("w", evaluate.outcome(F.col("s"), F.col("e"), F.col("m"), F.col("j")).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_pareto(spark):
    rows = [(i, random.Random(i).randint(0, 9), random.Random(i + 99).randint(0, 9), random.Random(i + 7).randint(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int")
    for more, less in ((["a", "b"], []), (["a"], ["c"]), (["a", "b"], ["c"])):
        value = lambda r: [r["id abc".index("abc"[0]) if False else {"a": 1, "b": 2, "c": 3}[x]] * (1 if x in more else -1) for x in more + less]  # noqa: B023, E731
        want = {r[0] for r in rows if not any(all(y >= x for x, y in zip(value(r), value(o), strict=True)) and value(o) != value(r) for o in rows)}
        assert {r.id for r in evaluate.pareto(df, more, less).collect()} == want
