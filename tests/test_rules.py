import pytest

from folioscope.operators import rules
from folioscope.operators.lexicon import PACKS, Regional
from folioscope.operators.rules import Context, Settings


def scenes(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "scene int, text string")


def hits(spark, rule, text, lang="en", **more):
    settings = more.pop("settings", Settings(language=lang))
    ctx = Context(PACKS[lang], settings, **more)
    found = {r.id: r for r in rules.RULES}[rule].detect(scenes(spark, text), ctx).orderBy("start").collect()
    for d in found:
        assert text[d.start : d.start + len(d.target)] == d.target
    return [(d.start, d.target, d.replacement) for d in found]


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [
        ("Mum came came late.", "en", [(4, "came came", "came")]),
        ("She said\nSaid yes. 😀 ok ok", "en", [(4, "said\nSaid", "said"), (21, "ok ok", "ok")]),
        ("He had had that that.", "en", []),
        ("Он видел дом дом.", "ru", [(9, "дом дом", "дом")]),
    ],
)
def test_doubled_word(spark, text, lang, want):
    assert hits(spark, "repetition.doubled-word", text, lang) == want


def test_doubled_word_kept_in_dialogue(spark):
    s = Settings(preserve=("intentional-repetition",))
    assert hits(spark, "repetition.doubled-word", "“Go go,” he said said.", settings=s) == [(12, "said said", "said")]


def test_whitespace(spark):
    rule = "typography.whitespace"
    assert [t for _, t, _ in hits(spark, rule, "Rain came . We left , too late ;")] == ["e .", "t ,", "e ;"]
    assert hits(spark, rule, "Set the dial to .7, not .75 of it.") == []
    assert hits(spark, rule, "About .2 of a turn.") == []
    assert hits(spark, rule, "one  two  \nthree\t") == [(2, "e  t", "e t"), (7, "o  ", "o"), (15, "e\t", "e")]


def test_balance(spark):
    assert hits(spark, "punctuation.balance", "Look (here.") == [(6, "here.", "here).")]
    assert hits(spark, "punctuation.balance", "Look (here).\n\nAnd [there") == [(19, "there", "there]")]
    got = rules.balance_warnings(scenes(spark, 'a (b\n\n"c'), ["scene"]).collect()
    assert [(r.start, r.kind) for r in got] == [(0, "()"), (6, "quotes")]


def test_quotes(spark):
    assert hits(spark, "typography.quotes", '"One ‘two’ three"', settings=Settings(quotes="«»")) == [(0, '"One ‘two’ three"', "«One ‘two’ three»")]
    assert hits(spark, "typography.mixed-quotes", '"Mixed,” he said.', quote_style="curly") == [(0, '"Mixed,”', "“Mixed,”")]
    assert hits(spark, "typography.mixed-quotes", '"Mixed,” he said.') == []
    assert rules.dominant_quote_style(scenes(spark, "“a” " * 5)) == "curly"
    assert rules.dominant_quote_style(scenes(spark, "“a” " * 4)) is None


def test_dashes(spark):
    rule = "typography.dashes-ellipsis"
    assert hits(spark, rule, "Wait... then go.", settings=Settings(ellipsis=True)) == [(4, "...", "…")]
    assert hits(spark, rule, "yes - no. In May.. He\n- Hi") == [(2, "s - n", "s — n"), (13, "May..", "May."), (22, "- H", "— H")]


@pytest.mark.parametrize(
    ("text", "n"),
    [("Stop. next time.", 1), ("Wait... next", 0), ("Mr. smith", 0), ("like B. alba there", 0), ("Take 2 lb. sugar", 0), ("we sat. idle all day", 0), ("Really! yes", 0), ("Really!\nyes", 1)],
)
def test_sentence_start(spark, text, n):
    assert len(hits(spark, "capitalization.sentence-start", text)) == n


def test_markdown(spark):
    rule = "markdown.stray-marker"
    assert hits(spark, rule, "An odd ## sign here.") == [(5, "d ## s", "d s")]
    assert hits(spark, rule, "Fine.\n\nbo**ld and it\\! on_ x") == [(8, "o**l", "ol"), (19, "t\\!", "t!"), (24, "n_", "n")]


def test_spelling(spark):
    counts = spark.createDataFrame([("colour", 1), ("color", 2)], "word string, n long")
    assert hits(spark, "consistency.spelling-variant", "Colour color color", counts=counts) == [(0, "Colour", "Color")]
    assert hits(spark, "consistency.spelling-variant", "color", settings=Settings(spelling="british")) == [(0, "color", "colour")]
    yo = spark.createDataFrame([("ёлка", 2)], "word string, n long")
    assert hits(spark, "consistency.spelling-variant", "елка ель", "ru", counts=yo, settings=Settings(language="ru", yo="yo")) == [(0, "елка", "ёлка")]
    assert hits(spark, "consistency.spelling-variant", "Ёлка", "ru", settings=Settings(language="ru", yo="e")) == [(0, "Ёлка", "Елка")]


def test_region(spark):
    terms = Regional.parse('{"terms":[{"kind":"spelling","gb":["realised"],"us":["realized"]},{"kind":"word","gb":["autumn"],"us":["fall"],"shared":["gb"],"polysemous":["us"]},{"kind":"word","gb":["queue"],"us":["line"]},{"kind":"word","gb":["chemist\'s"],"us":["drugstore"]}]}')
    text = "Nobody realised how short autumn was. “There is a queue outside the chemist’s,” Tom told us."
    ctx = Context(PACKS["en"], Settings(language="en-US"), regional=terms)
    got = rules.region_variant(scenes(spark, text), ctx).orderBy("start").collect()
    assert [(d.target, d.replacement, d.authority) for d in got] == [("realised", "realized", "contextual"), ("autumn", "fall", "semantic"), ("queue", "line", "semantic"), ("chemist’s", "drugstore", "semantic")]
    assert rules.region_variant(scenes(spark, text), Context(PACKS["en"], Settings(language="en"), regional=terms)).count() == 0


def test_names(spark):
    names = spark.createDataFrame([("Mara", 2, 0), ("Maro", 1, 5), ("Fowler", 5, 1), ("Fowlers", 1, 9)], "name string, n long, first long")
    assert hits(spark, "terminology.name-variant", "He saw Maro. The Fowlers.", names=names) == [(7, "Maro", "Mara")]
    s = Settings(canonical_names=(("Katherine", ("Catherine",)), ("John", ("Jon",)), ("Jonas", ("Jon",))))
    ctx = Context(PACKS["en"], s)
    got = rules.name_variant(scenes(spark, "Catherine met Jon."), ctx).orderBy("start").collect()
    assert [(d.target, d.replacement, d.authority) for d in got] == [("Catherine", "Katherine", "contextual"), ("Jon", "John", "semantic")]


def test_russian(spark):
    n = "grammar.ru-sutki-numeral"
    assert hits(spark, n, "Шли четыре холодных суток.", "ru") == [(4, "четыре холодных суток", "четверо холодных суток")]
    assert hits(spark, n, "Ждали двое суток. Хватило двух суток. Ушли два дня. «Две суток», — сказал сосед.", "ru") == []
    assert hits(spark, n, "Ждали сорок два суток.", "ru") == []
    p = "grammar.ru-pronoun-byl"
    assert hits(spark, p, "Оно были тут.", "ru") == [(0, "Оно были", "Оно было")]
    assert hits(spark, p, "Оно было тут. Они были там. «Оно были тут», — смеялся сосед.", "ru") == []


def test_detect_and_propose(spark):
    texts = scenes(spark, "Mum came came yes - no.", "Fine.", None, "")
    drafts = rules.detect(texts, Context(PACKS["en"], Settings()))
    assert {r.rule for r in drafts.collect()} == {"repetition.doubled-word", "typography.dashes-ellipsis"}
    got = rules.proposals(drafts, texts, ["scene"]).orderBy("start").collect()
    assert [(p.target, p.replacement, p.start) for p in got] == [("came came", "came", 4), ("yes - no", "yes — no", 14)]
    assert len({p.proposal_id for p in got}) == 2
    kept = rules.proposals(drafts, texts, ["scene"], ("yes - no",)).collect()
    assert [p.target for p in kept] == ["came came"]
