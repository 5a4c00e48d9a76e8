from pyspark.sql import functions as F

from folioscope.operators import lexicon, metrics, segment
from folioscope.operators.lexicon import PACKS


def one(spark, make, text):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_words(spark):
    text = "At 10:14 on 12.09.2026, the value was 3.14. Don’t 😀 stop"
    assert one(spark, segment.words, text) == ["At", "10:14", "on", "12.09.2026", "the", "value", "was", "3.14", "Don’t", "stop"]
    spans = one(spark, segment.word_spans, text)
    assert all(text[s.start : s.end] == s.text for s in spans)
    assert [s.text for s in spans] == one(spark, segment.words, text)


def test_scenes(spark):
    text = "intro\n<!-- scene: a -->\nOne.\n<!-- scene: b -->\nTwo."
    got = one(spark, segment.scenes, text)
    assert [(s.scene_id, s.text, s.implicit) for s in got] == [("s0", "intro\n", True), ("a", "One.\n", False), ("b", "Two.", False)]
    assert all(text[s.start : s.end] == s.text for s in got)
    assert [(s.scene_id, s.text) for s in one(spark, segment.scenes, "plain")] == [("s0", "plain")]


def test_paragraphs(spark):
    text = "a\nb\n\n\n  \n\nc\r\n\r\nd"
    got = one(spark, segment.paragraphs, text)
    assert [p.text for p in got] == ["a\nb", "c", "d"]
    assert all(text[p.start : p.end] == p.text for p in got)


def test_sentences(spark):
    text = "Prof. Nilsen waved. Then it rained! “Truly?” we asked. Line one\nline two"
    got = one(spark, lambda t: segment.sentences(t, PACKS["en"]), text)
    assert [s.text.strip() for s in got] == ["Prof. Nilsen waved.", "Then it rained!", "“Truly?”", "we asked.", "Line one", "line two"]
    assert all(text[s.start : s.end] == s.text for s in got)
    assert len(one(spark, lambda t: segment.sentences(t, PACKS["en"]), "Prof. Nilsen waved. Then it rained.")) == 2


def test_dialogue(spark):
    text = "— Привет, Иван.\nОн ответил: «Здравствуй». \\«нет\\» «не закрыто"
    got = one(spark, lambda t: segment.dialogue(t, PACKS["ru"]), text)
    assert [d.text for d in got] == ["— Привет, Иван.", "«Здравствуй»"]
    long = "“" + "word " * 20000
    assert one(spark, lambda t: segment.dialogue(t, PACKS["en"]), long) == []  # an open quotation of any length


def test_diff_and_offsets(spark):
    row = spark.createDataFrame([("the old cat", "the new cat")], "a string, b string")
    assert [(d.kind, d.text) for d in row.select(segment.word_diff("a", "b")).first()[0]] == [("same", "the "), ("removed", "old"), ("added", "new"), ("same", " cat")]
    got = one(spark, segment.normalized_with_offsets, "a \n éx")
    assert (got.text, got.starts, got.ends) == ("a éx", [0, 1, 4, 6], [1, 4, 6, 7])


def test_batches():
    assert list(segment.batches_by_budget([3, 3, 5, 1, 9, 1], 6)) == [(0, 2), (2, 4), (4, 5), (5, 6)]


def test_derived_stopwords(spark):
    docs = spark.createDataFrame([(0, "quiet quiet the t")], "ord int, text string")
    assert [(r.word, r.n) for r in lexicon.derived_stopwords(docs).orderBy("rank").collect()] == [("t", 3), ("quie", 2), ("the", 1)]
    assert lexicon.load_pack("xx", ("a",)).derived
    assert lexicon.load_pack("en-GB").language == "en"


def test_metrics(spark):
    plain = "One short thing happened here today."
    scenes = spark.createDataFrame([("b", i, plain + str(i)) for i in range(3)] + [("b", 3, "The silver bell echoed. " * 4)], "book string, scene int, text string")
    m = metrics.scene_metrics(scenes, PACKS["en"], ["book", "scene"], ["book"])
    hot = metrics.scene_hotspots(m, ["book", "scene"], ["book"]).collect()
    assert (3, "ngram-repeats") in {(h.scene, h.metric) for h in hot}
    assert all(h.value > h.baseline and h.value >= h.floor for h in hot)
    assert "adverbs" not in metrics.scene_metrics(scenes, PACKS["ru"], ["book", "scene"], ["book"]).columns
    values = m.where("scene = 3").first().asDict()
    assert values["words"] == 16 and values["ngram-repeats"] == 3 + 3 + 2 + 2  # silver bell echoed, bell echoed the, ...
    assert values["opening-repetition"] == 1.0


def test_proper_nouns(spark):
    scenes = spark.createDataFrame([(0, "We met Tilda. Nobody knew Tilda. Often Tildo sang.")], "scene int, text string")
    assert {r["name"]: r.n for r in metrics.proper_nouns(scenes, PACKS["en"], order=("scene",)).collect()} == {"Tilda": 2, "Tildo": 1}


def test_words_are_walked_in_portions(spark):
    """Whatever the batches, words keep their places, and a word takes little memory while a text is walked."""
    import tracemalloc

    import pyarrow as pa

    texts = ["One, two", None, "", "x" * 300 + " y", "Don’t 😀 STOP", *("a b" for _ in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    for portion in (1, 64, 1 << 18):
        got = sorted((r.k, r.pos, r.start, r.end, r.text, r.lower) for r in segment.tokens_table(df, ["k"], portion=portion).collect())
        assert [(k, t, low) for k, _, _, _, t, low in got][:2] == [(0, "One", "one"), (0, "two", "two")] and len(got) == 2 + 2 + 2 + 100
        assert all(texts[k][a:b] == t and t.lower() == low for k, _, a, b, t, low in got)
    many = pa.array([" ".join(f"w{i}" for i in range(50_000))] * 2)
    tracemalloc.start()
    spans = segment.spans_of(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans.flatten()) == 200_000 and peak < 200 * 200_000
