"""Guards: what an edit may not change, as an ordered cascade of column tests; the first that holds is the reason."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.matching import EDGE, any_span, count, overlaps, texts, touches, within
from folioscope.functions.numbers import floor_quantiles
from folioscope.functions.text import changed_span, mark_profile, osa_distance
from folioscope.operators.lexicon import Pack
from folioscope.operators.segment import dialogue, lower_words, sentences, words

# Words whose change may change the sense.
LEXICONS: dict[str, dict[str, tuple[str, ...]]] = {
    "en": {
        "certainty": tuple("seemed apparently suspected unsure certain possible definitely sure knew".split()),
        "location": tuple("upstairs downstairs north south east west inside outside front back above below under over station church drawer cupboard window fireplace table".split()),
        "ownership": tuple("his her hers their theirs my mine your yours our ours belonged owned".split()),
        "chronology": tuple("before after first last yesterday tomorrow morning evening earlier later already yet monday tuesday dawn dusk midnight".split()),
        "intention": tuple("wanted planned intended hoped tried meant resolved help harm leave stay return escape hide reveal refuse accept confess deny warn accuse forgive punish wait go save abandon".split()),
    },
    "ru": {
        "certainty": tuple("казался видимо подозревал сомневалась уверена несомненно знал".split()),
        "location": tuple("наверху внизу север юг снаружи внутри переднюю заднюю станции церкви ящике шкафу окна печи столе столом".split()),
        "ownership": tuple("его её их мой моя свой свою свои принадлежал".split()),
        "chronology": tuple("до после первой последней вчера завтра утром вечером раньше позже уже ещё понедельник вторник рассвете закате полуночи".split()),
        "intention": tuple("хотел хотела собирался собиралась намеревались надеялись пытался решил помочь навредить уйти остаться вернуться сбежать скрыть раскрыть отказаться согласиться признаться отрицать предупредить обвинить простить наказать подождать спасти бросить".split()),
    },
}
NUMBERS = tuple("one two three four five six seven eight nine ten twenty thirty один два три четыре пять шесть семь восемь двадцать тридцать".split())
NOT_NAMES = tuple("The He She They It There This That At In On What Let But And For Он Она Они Это Было Ключ Деньги Поезд Дверь Письмо Часы Книга".split())
#: Traps that a typo sets off as well: such an edit is kept for review.
REVIEWED = ("dialogue-content-change", "negation-change", "proper-name-change")


@dataclass(frozen=True)
class Edit:
    """Columns of the edits that are judged."""

    before: Column
    after: Column
    category: Column
    in_dialogue: Column
    from_model: Column
    prefix: Column | None = None  # the scene's text before the target
    book_names: Column | None = None  # array of the collection's names
    allow_comma: Column | None = None
    typo_allowed: Column | None = None


def selected(text: Column, listed: tuple[str, ...]) -> Column:
    """The text's words that are listed, in order."""
    return F.filter(lower_words(text), lambda w: w.isin(*listed)) if listed else F.array().cast("array<string>")


def changed(a: Column, b: Column) -> Column:
    """Whether two word lists differ as multisets."""
    return F.array_sort(a) != F.array_sort(b)


def comma_only(before: Column, after: Column) -> Column:
    """The texts differ in commas alone, and in their number."""
    bare = lambda t: F.replace(t, F.lit(","), F.lit(""))
    return (F.length(before) - F.length(bare(before)) != F.length(after) - F.length(bare(after))) & (bare(before) == bare(after))


def ellipses(text: Column) -> Column:
    return count(text, r"…|(?<!\.)\.{3}(?!\.)")


def numbers(text: Column) -> Column:
    return F.filter(lower_words(text), lambda w: F.regexp_like(w, F.lit("^[0-9]")) | w.isin(*NUMBERS))


@F.pandas_udf(T.ArrayType(T.StringType()))
def names_in(text: pd.Series, prefix: pd.Series, known: pd.Series) -> pd.Series:
    """Capitalised words that are names: not the listed ones, nor one that opens a sentence unless the book knows it.

    With a null ``known`` every capitalised word that isn't listed is a name.
    """
    import regex

    from folioscope.operators.segment import WORD

    word, end = regex.compile(WORD), regex.compile(r"[.!?…][\p{Pe}\p{Pf}\"'»]*$|[\p{Ps}\p{Pi}\"«]$|(?:^|\n)[ \t]*[—–-]$")

    def opens(before: str) -> bool:
        bare = before.rstrip()
        return not bare or "\n" in before[len(bare) :] or bool(end.search(bare))

    def one(t: str | None, p: str | None, k: object) -> list[str]:
        have = None if k is None else set(k)
        return [m[0] for m in word.finditer(t or "") if m[0][0].isupper() and len(m[0]) > 1 and m[0] not in NOT_NAMES and not (have is not None and m[0] not in have and opens((p or "") + (t or "")[: m.start()]))]

    return pd.Series([one(*row) for row in zip(text, prefix, known, strict=True)])


@F.pandas_udf(T.BooleanType())
def names_changed(before: pd.Series, after: pd.Series, by_stem: pd.Series) -> pd.Series:
    """Whether the distinct names differ; by stem where names are inflected, each being matched once."""

    def same(a: str, b: str, stem: bool) -> bool:
        if not stem:
            return a == b
        a, b = a.lower(), b.lower()
        return a == b or (len(a) == len(b) > 1 and a[:-1] == b[:-1]) or (len(a) >= 6 and len(b) >= 6 and a[:6] == b[:6])

    def one(a: object, b: object, stem: bool) -> bool:
        x, rest = list(dict.fromkeys(a)), list(dict.fromkeys(b))
        if len(x) != len(rest):
            return True
        for n in x:
            i = next((i for i, m in enumerate(rest) if same(n, m, stem)), None)
            if i is None:
                return True
            rest.pop(i)
        return False

    return pd.Series([one(*row) for row in zip(before, after, by_stem, strict=True)])


@F.pandas_udf(T.BooleanType())
def name_dropped(text: pd.Series, before: pd.Series, after: pd.Series, by_stem: pd.Series) -> pd.Series:
    """Whether a name occurs less often afterwards, by more than its immediate repetitions."""
    import regex

    def same(a: str, b: str, stem: bool) -> bool:
        if not stem:
            return a == b
        a, b = a.lower(), b.lower()
        return a == b or (len(a) == len(b) > 1 and a[:-1] == b[:-1]) or (len(a) >= 6 and len(b) >= 6 and a[:6] == b[:6])

    def one(t: str, a: object, b: object, stem: bool) -> bool:
        for n in set(a):
            twice = len(regex.findall(rf"(?<!\p{{L}}){regex.escape(n)}\s+{regex.escape(n)}(?!\p{{L}})", t))
            if sum(same(m, n, stem) for m in a) - sum(same(m, n, stem) for m in b) > twice:
                return True
        return False

    return pd.Series([one(*row) for row in zip(text, before, after, by_stem, strict=True)])


def typo_only(before: Column, after: Column) -> Column:
    """The same number of words, each the same or within a third of its letters (two at most) of the other.

    Distances are taken for whole word lists at once, in one Arrow pass.
    """
    return close_words(lower_words(before), lower_words(after))


@F.pandas_udf(T.BooleanType())
def close_words(before: pd.Series, after: pd.Series) -> pd.Series:
    distance = osa_distance.func

    def one(a: object, b: object) -> bool:
        a, b = list(a), list(b)
        if len(a) != len(b):
            return False
        pairs = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        if not pairs:
            return True
        got = distance(pd.Series([x for x, _ in pairs]), pd.Series([y for _, y in pairs]))
        return all(k <= min(2, max(len(x), len(y)) // 3) for k, (x, y) in zip(got, pairs, strict=True))

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])


def typo_shaped(before: Column, after: Column) -> Column:
    """A typo's shape: the same marks, and close words, other spaces, or one letter more or less."""
    glued = lambda t: F.array_join(lower_words(t), "")
    one = (F.abs(F.length(glued(before)) - F.length(glued(after))) == 1) & (osa_distance(glued(before), glued(after)) == 1)
    return (before != after) & (mark_profile(before) == mark_profile(after)) & (typo_only(before, after) | (glued(before) == glued(after)) | one)


def semantic_trap(e: Edit, pack: Pack, review: bool = False) -> Column:
    """Name of the first trap the edit sets off, or null. ``review`` leaves out those a typo sets off by itself."""
    b, a = e.before, e.after
    lang = pack.language
    no = F.lit(False)
    comma = (e.allow_comma if e.allow_comma is not None else no) & (e.category == "punctuation") & comma_only(b, a)
    inflects = F.lit(lang != "en")
    known = e.book_names if e.book_names is not None else F.lit(None).cast("array<string>")
    prefix = e.prefix if e.prefix is not None else F.lit(None).cast("string")
    nb, na = names_in(b, prefix, known), names_in(a, prefix, known)
    lexicon = LEXICONS.get(lang, {})
    differ = lambda listed: changed(selected(b, listed), selected(a, listed))
    marks = lambda t: F.regexp_replace(t, r"[^.,;:!?…—–'’\"“”‘-]", "")
    bare = lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    gerund = r"(?iu)(?:^|\s)[а-яё]{3,}(?:в|вши|ши)(?:сь)?(?=\s|,|$)"
    not_contracted = rf"(?iu){EDGE}\p{{L}}+n['’]t{EDGE}"
    said = lambda t: F.array_join(lower_words(t), " ")
    cascade: list[tuple[Column, str]] = [
        (ellipses(b) != ellipses(a), "ellipsis-change"),
        ((a != b) & (F.regexp_replace(a, r"\s+\z", "") == b), "trailing-space-only"),
        ((a != b) & (F.regexp_replace(a, r"(?iu),\s+(?=и(?!\p{L})|and" + EDGE + ")", " ") == b), "coordinate-comma-insertion"),
        (e.from_model & comma_only(b, a) & ~comma, "unsupported-comma-change"),
    ]
    if lang == "ru":
        yo = lambda t: F.translate(t, "ёЁ", "еЕ")
        cascade += [
            (e.from_model & (a != b) & (yo(a) == yo(b)), "yo-normalization"),
            (F.regexp_like(a, F.lit(gerund)) & ~F.regexp_like(b, F.lit(gerund)) & F.regexp_like(b, F.lit(r"(?iu)(?:^|\s)и(?=\s)")), "sequence-to-gerund-change"),
        ]
    cascade += [
        (e.from_model & ~comma & (bare(b) == bare(a)) & (marks(b) != marks(a)), "punctuation-style-only"),
        (changed(numbers(b), numbers(a)), "number-date-time-change"),
    ]
    if not review:
        cascade += [(count(b, not_contracted) != count(a, not_contracted), "negation-change"), (differ(pack.negation), "negation-change")]
    dropped = name_dropped(b, nb, na, inflects)
    cascade += [
        (dropped if review else names_changed(nb, na, inflects) | dropped, "proper-name-change"),
        (differ(pack.modal), "certainty-change"),
        (differ(lexicon.get("certainty", ())), "certainty-change"),
        *((differ(lexicon.get(k, ())), f"{k}-change") for k in ("location", "ownership", "intention", "chronology")),
    ]
    spoken = e.in_dialogue & (said(b) != said(a))
    if not review:
        cascade.append((spoken & (e.category != "dialogue-mechanics"), "dialogue-content-change"))
    typo = (e.typo_allowed if e.typo_allowed is not None else no) & typo_only(b, a)
    cascade.append((spoken & (e.category == "dialogue-mechanics") & e.from_model & ~typo, "dialogue-mechanics-content-change"))
    out = F.lit(None).cast("string")
    for test, name in reversed(cascade):
        out = F.when(test, name).otherwise(out)
    return out


def typo_reviewable(trap: Column, e: Edit, pack: Pack) -> Column:
    """Whether an edit that set off a trap has a typo's shape and passes all else, so a person should see it."""
    glued = lambda t: F.array_join(lower_words(t), "")
    known = e.book_names if e.book_names is not None else F.lit(None).cast("array<string>")
    prefix = e.prefix if e.prefix is not None else F.lit(None).cast("string")
    nb, na = names_in(e.before, prefix, known), names_in(e.after, prefix, known)
    held = lambda own, others, there: F.forall(F.array_except(own, others), lambda n: F.array_contains(there, F.lower(n)))
    case_only = held(nb, na, lower_words(e.after)) & held(na, nb, lower_words(e.before))
    return (
        trap.isin(*REVIEWED)
        & typo_shaped(e.before, e.after)
        & ((trap != "negation-change") | (glued(e.before) == glued(e.after)))
        & ((trap != "proper-name-change") | case_only)
        & semantic_trap(e, pack, review=True).isNull()
    )


def punctuation(text: Column) -> Column:
    return count(text, "[;:—–…!?]")


def voice_limits(scenes: DataFrame, pack: Pack, book: list[str]) -> DataFrame:
    """book, n, low, high, marks: quartile range of sentence lengths and the limit of marks in a sentence.

    ``low`` and ``high`` are null for fewer than 20 sentences with words.
    """
    rows = scenes.select(*book, F.explode(sentences(F.col("text"), pack)).alias("s"))
    rows = rows.select(*book, F.size(words(F.col("s.text"))).alias("len"), punctuation(F.col("s.text")).alias("marks"))
    some = rows.where("len > 0")
    stats = some.groupBy(*book).agg(F.count(F.lit(1)).alias("n"))
    stats = stats.join(floor_quantiles(some, book, "len", {"q1": 0.25, "q3": 0.75}), book).join(floor_quantiles(rows, book, "marks", {"m": 0.75}), book)
    wide = F.greatest(F.lit(1), F.col("q3") - F.col("q1"))
    ok = F.col("n") >= 20
    return stats.select(*book, "n", F.when(ok, F.col("q1") - wide).alias("low"), F.when(ok, F.col("q3") + wide).alias("high"), F.when(ok, F.col("m") + 1).alias("marks"))


def sentence_at(text: Column, offset: Column, pack: Pack) -> Column:
    """The sentence that holds an offset, or the whole text."""
    met = F.filter(sentences(text, pack), lambda s: (offset >= s["start"]) & (offset <= s["end"]))
    return F.coalesce(F.get(met, 0)["text"], text)


def voice_reason(scene: Column, start: Column, end: Column, replacement: Column, category: Column, pack: Pack, limits: Column, preserve: tuple[str, ...] = (), normalized: bool = False) -> Column:
    """Why an edit breaks the voice of the collection: dialogue, fragments, lengths, marks or register; else null."""
    target = F.substring(scene, start + 1, end - start)
    spoken = dialogue(scene, pack)
    change = changed_span(target, start, replacement)
    span = F.struct(start.alias("start"), end.alias("end"))
    in_speech = any_span(spoken, lambda s: within(span, s)) | any_span(spoken, lambda s: touches(change, s))
    edited = F.concat(F.substring(scene, F.lit(1), start), replacement, F.substring(scene, end + 1, F.length(scene)))
    old, new = sentence_at(scene, start, pack), sentence_at(edited, start, pack)
    n, m = F.size(words(old)), F.size(words(new))
    said = lambda t: F.array_join(lower_words(t), " ")
    register = lambda t: F.size(selected(t, tuple(w.lower() for w in (*pack.formal, *pack.informal))))
    two = r"[.!?…]\s+\p{L}"
    low, high = limits["low"], limits["high"]
    tests = []
    if not normalized:
        tests.append((in_speech & category.isin("grammar", "word-choice", "clarity", "sentence-structure", "redundancy", "repetition", "prose-pattern"), "dialogue-register-preserved"))
    if "sentence-fragments" in preserve:
        tests.append((F.regexp_like(target, F.lit(two)) & ~F.regexp_like(replacement, F.lit(two)), "sentence-fragment-preserved"))
    if not normalized and {"dialect", "informal-dialogue"} & {*preserve}:
        tests.append((in_speech & (said(target) != said(replacement)), "dialogue-language-preserved"))
    tests += [
        (F.coalesce((n >= low) & (n <= high) & ((m < F.greatest(F.lit(1), low)) | (m > high)), F.lit(False)), "sentence-length-outlier"),
        (F.coalesce((punctuation(old) <= limits["marks"]) & (punctuation(new) > limits["marks"]), F.lit(False)), "punctuation-profile-outlier"),
        (low.isNotNull() & (register(new) > register(old) + 1), "register-shift"),
    ]
    out = F.lit(None).cast("string")
    for test, name in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out


def classify(target: Column, replacement: Column, pack: Pack) -> Column:
    """mechanical for changes of white space and for the pack's spelling variants, else prose."""
    tidy = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    plain = lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", "")
    pairs = F.lit(False)
    for x, y in pack.spelling_variants:
        pairs = pairs | ((plain(target) == x) & (plain(replacement) == y)) | ((plain(target) == y) & (plain(replacement) == x))
    return F.when(tidy(target) == tidy(replacement), "mechanical").when(mark_profile(target) != mark_profile(replacement), "prose").when(pairs, "mechanical").otherwise("prose")


def hedged(reason: Column) -> Column:
    """Whether a reason takes itself back."""
    return F.size(texts(F.lower(reason), r"\b(?:might be|maybe|possibly|not sure|could be intentional)\b")) > 0


__all__ = ["Edit", "changed", "classify", "comma_only", "overlaps", "semantic_trap", "typo_reviewable", "typo_shaped", "voice_limits", "voice_reason"]
